"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from .common import fold, in_python, sampled_ids, texts_of
from .textarrays import CHAR_INVERSE, Words, slices, text_pieces

#: At most so many labelled texts fit the lexicon and the last step.
FIT_ROWS = 12_000
#: Letters of the stems that are tried; 0 is the whole word.
STEM_LETTERS = (4, 5, 6, 7, 8, 0)
#: A stem is an insult if it is found in so many toxic texts, and its odds there are so many times those elsewhere; one for which only that holds
#: where a target stands in its clause is a threat.
LEAST_TEXTS, LEAST_ODDS = 4, 12.0

# Words of the grammar's closed classes, in the four languages of the corpus; threats to begin with, more are learned.
THREATS = "kill hurt destroy crush burn beat shoot stab strangle töten umbringen schlagen verletzen tuer frapper détruire blesser matar golpear destruir herir"
TARGETS = "you your you're yourself they them he she him her du dich dir dein ihr euch tu toi vous votre il elle tú usted ustedes vosotros él ella"
NEGATIONS = "not no never cannot nobody nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún ninguna"
REPORTS = "said says called reported wrote quoted claimed sagte nannte berichtete schrieb dit disait écrit déclaré dijo llamó escribió informó"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, STOP = range(7)
SYMBOLS = 7
#: What a modifier may have said about a symbol: that it is negated, that it is reported, or both.
NEGATED, REPORTED = 1, 2
FLAGS = 4
#: What is left of the points of an insult and of a threat, by flags.
INSULT_FACTOR = (1.0, 0.5, 0.5, 0.25)
THREAT_FACTOR = (1.0, 0.2, 0.5, 0.1)


class Transducer:
    """A table of (state, symbol) -> (next state, flags, points); state 0 is the first. What no arc names stays in its state.

    Modifiers read plain symbols and write flags. Scorers read symbols with flags, at symbol + SYMBOLS * flags, and write points.
    """

    def __init__(self, states: int, arcs: dict[tuple[int, int], tuple], symbols: int = SYMBOLS):
        self.next = np.repeat(np.arange(states)[:, None], symbols, axis=1)
        self.flags, self.points = np.zeros((states, symbols), np.int64), np.zeros((states, symbols))
        for (state, symbol), (to, flags, points) in arcs.items():
            self.next[state, symbol], self.flags[state, symbol], self.points[state, symbol] = to, flags, points

    def beside(self, other: Transducer) -> Transducer:
        """Both on the same symbols, over pairs of states: flags are put together, points add up."""
        a, b = len(self.next), len(other.next)
        x, y = np.repeat(np.arange(a), b), np.tile(np.arange(b), a)
        out = Transducer(a * b, {}, self.next.shape[1])
        out.next = self.next[x] * b + other.next[y]
        out.flags, out.points = self.flags[x] | other.flags[y], self.points[x] + other.points[y]
        return out

    def into(self, scorer: Transducer) -> Transducer:
        """This modifier first, the scorer on what it writes: a table over plain symbols with points."""
        a, b = len(self.next), len(scorer.next)
        x, y = np.repeat(np.arange(a), b), np.tile(np.arange(b), a)
        out = Transducer(a * b, {})
        told = np.arange(SYMBOLS)[None, :] + SYMBOLS * self.flags[x]
        out.next = self.next[x] * b + scorer.next[y[:, None], told]
        out.points = scorer.points[y[:, None], told]
        return out


def transducers() -> dict[str, Transducer]:
    """The five of the grammar. A pending threat or insult keeps the flags it came with until its target does."""
    # a negation holds for the three words after it, a report to the end of its clause
    fade = {(k, s): (k - 1, NEGATED * (s in (INSULT, THREAT)), 0) for k in (1, 2, 3) for s in (OTHER, TARGET, REPORT, INSULT, THREAT)}
    negation = fade | {(k, NEGATION): (3, 0, 0) for k in range(4)} | {(k, STOP): (0, 0, 0) for k in range(4)}
    reported = {(0, REPORT): (1, 0, 0), (1, STOP): (0, 0, 0)} | {(1, s): (1, REPORTED, 0) for s in (INSULT, THREAT)}
    insult = {(0, INSULT + SYMBOLS * f): (0, 0, INSULT_FACTOR[f]) for f in range(FLAGS)}
    threat, target = {}, {}
    # states: 0 nothing, 1 a target seen, 2 + flags a threat or an insult that waits for its target
    for arcs, symbol, points in ((threat, THREAT, THREAT_FACTOR), (target, INSULT, tuple(x / 2 for x in INSULT_FACTOR))):
        after = 1 if symbol == THREAT else 0  # a target may serve several threats, but each insult wants its own
        for f in range(FLAGS):
            arcs[0, symbol + SYMBOLS * f] = (2 + f, 0, 0)
            arcs[1, symbol + SYMBOLS * f] = (after, 0, points[f])
            arcs[2 + f, TARGET] = (after, 0, points[f])
            for g in range(FLAGS):  # of two that wait, the stronger one does
                arcs[2 + f, symbol + SYMBOLS * g] = (2 + (g if points[g] > points[f] else f), 0, 0)
        arcs[0, TARGET] = (1, 0, 0)
        arcs |= {(state, STOP): (0, 0, 0) for state in range(2 + FLAGS)}
    wide = SYMBOLS * FLAGS
    return {
        "negation": Transducer(4, negation),
        "reported": Transducer(2, reported),
        "insult": Transducer(1, insult, wide),
        "threat": Transducer(2 + FLAGS, threat, wide),
        "target": Transducer(2 + FLAGS, target, wide),
    }


@lru_cache(1)
def grammar() -> Transducer:
    """Insults and threats score; a target beside them adds, negation and reported speech before them take away."""
    t = transducers()
    return t["negation"].beside(t["reported"]).into(t["insult"].beside(t["threat"]).beside(t["target"]))


class _Tokens:
    """Words of some texts in lower case, without what isn't a letter around them. denied: words that end in n't, with either apostrophe."""

    def __init__(self, texts: list):
        self.words = w = Words([(t or "").lower() for t in texts])
        c = w.codes
        letter = ((c >= 97) & (c <= 122)) | (c >= 192)
        at = np.arange(len(c))
        after = np.minimum.accumulate(np.where(letter, at, len(c))[::-1])[::-1] if len(c) else at
        before = np.maximum.accumulate(np.where(letter, at, -1)) if len(c) else at
        self.start = np.minimum(after[w.start], w.end) if len(w.start) else w.start
        self.end = np.maximum(before[w.end - 1] + 1, self.start) if len(w.end) else w.end
        size = self.end - self.start
        tail = lambda k: c[np.maximum(self.end - k, 0)] if len(c) else c
        self.denied = (size >= 3) & (tail(1) == ord("t")) & np.isin(tail(2), np.array([ord("'"), 0x2019], np.uint32)) & (tail(3) == ord("n")) if len(w.end) else size > 0
        last = c[w.end - 1] if len(w.end) else c[:0]
        self.stop = np.isin(last, np.array([ord(x) for x in ".,;:!?"], np.uint32))
        lines = np.concatenate([[0], np.cumsum(c == 10)])
        self.stop |= np.append((w.doc[1:] != w.doc[:-1]) | (lines[w.start[1:]] != lines[w.end[:-1]]), True)[: len(w.doc)]
        self.doc, self.size = w.doc, size
        self.clause = np.concatenate([[0], np.cumsum(self.stop)])[: len(w.doc)]

    def stems(self, letters: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words are longer than so many letters, and the key of their first ones; letters 0: whole words."""
        on = np.flatnonzero(self.size > letters if letters else self.size > 0)
        end = self.start[on] + letters if letters else self.end[on]
        salt = np.uint64((letters + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
        return on, slices(self.words.prefix, self.start[on], end, CHAR_INVERSE) ^ salt


def _among(key: np.ndarray, words: str) -> np.ndarray:
    return np.isin(key, _Tokens(words.split()).stems(0)[1])


def aimed(tokens: _Tokens) -> np.ndarray:
    """Which words stand in a clause with a target."""
    on, key = tokens.stems(0)
    return np.isin(tokens.clause, np.unique(tokens.clause[on[_among(key, TARGETS)]]))


def learn_stems(labelled: DataFrame) -> dict[int | tuple[str, int], dict[int, float]]:
    """Insults by number of letters, and threats by ("threat", letters): keys of stems with their weights, from rows (text, toxic).

    Counts texts with each stem, apart for toxic ones and for clauses with a target; Spark adds them up and leaves out the
    stems that are rare in toxic texts or no rarer in others; so few are left, as each is in several of the toxic texts of a bounded sample.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy().astype(np.int64)
            for a, b, texts in text_pieces(batch.column(0)):
                tokens = _Tokens(texts)
                near = aimed(tokens)
                for letters in STEM_LETTERS:
                    on, key = tokens.stems(letters)
                    doc, order = tokens.doc[on].astype(np.int64), np.lexsort((~near[on], tokens.doc[on], key))
                    # one row for each stem and text: is any of the stem's clauses in it aimed at somebody
                    new = np.ones(len(order), bool)
                    new[1:] = (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                    order = order[new]
                    names, of = np.unique(key[order], return_inverse=True)
                    own, at = toxic[a:b][doc[order]], near[on][order]
                    total = lambda which: np.bincount(of, which, minlength=len(names)).astype(np.int64)  # noqa: B023, E731
                    columns = [pa.array([letters] * len(names), pa.int32()), pa.array(names.view(np.int64)), *(pa.array(total(x)) for x in (own, 1 - own, own * at, (1 - own) * at))]
                    yield pa.RecordBatch.from_arrays(columns, names=["letters", "key", "bad", "good", "bad_at", "good_at"])

    totals = labelled.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    bad, every = int(totals[0] or 0), int(totals[1])
    out: dict = {n: {} for n in STEM_LETTERS} | {("threat", n): {} for n in STEM_LETTERS}
    if not bad or bad == every:
        return out
    counts = in_python(labelled.select("text", F.col("toxic").cast("int")), count, "letters int, key long, bad long, good long, bad_at long, good_at long")
    counts = counts.groupBy("letters", "key").agg(*(F.sum(c).alias(c) for c in ("bad", "good", "bad_at", "good_at")))
    odds = lambda b, g: ((F.col(b) + 0.1) / bad) / ((F.col(g) + 0.1) / (every - bad))
    kept = counts.where(F.col("bad") >= LEAST_TEXTS).withColumn("odds", odds("bad", "good")).withColumn("odds_at", odds("bad_at", "good_at"))
    threat = (F.col("odds") < LEAST_ODDS) & (F.col("bad_at") >= LEAST_TEXTS) & (F.col("odds_at") >= LEAST_ODDS)
    for r in kept.where((F.col("odds") >= LEAST_ODDS) | threat).select("letters", "key", "odds", "odds_at").collect():
        name, value = (r["letters"], r["odds"]) if r["odds"] >= LEAST_ODDS else (("threat", r["letters"]), r["odds_at"])
        out[name][r["key"]] = float(np.log(value))
    return out


def clause_scores(texts: list, stems: dict) -> np.ndarray:
    """For each text: points of all clauses, of its best clause, clauses that scored, and these per 100 words.

    An insult pays by its weight, before its target and after it alike: the weight of the one that waits is kept until the target comes. A
    threat pays 2, or its weight if it is learned.
    """
    tokens = _Tokens(texts)
    symbol = np.zeros(len(tokens.doc), np.int64)
    weight = np.full(len(tokens.doc), 2.0)
    on, key = tokens.stems(0)
    for name, known in sorted(stems.items(), key=lambda x: not isinstance(x[0], tuple)):  # threats first: an insult is one with or without a target
        if known:
            letters, code = (name[1], THREAT) if isinstance(name, tuple) else (name, INSULT)
            own, found = tokens.stems(letters)
            names = np.array(sorted(known), np.int64)
            value = np.array([known[x] for x in names.tolist()])
            at = np.minimum(np.searchsorted(names, found.view(np.int64)), len(names) - 1)
            hit = names[at] == found.view(np.int64)
            where, value = own[hit], value[at[hit]]
            weight[where] = np.where(symbol[where] == code, np.maximum(weight[where], value), value)
            symbol[where] = code
    for words, code in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)):
        where = on[_among(key, words)]
        if code == THREAT:
            where = where[symbol[where] == OTHER]
        symbol[where], weight[where] = code, 2.0
    symbol[tokens.denied] = NEGATION
    clause = tokens.clause
    hot = np.isin(clause, np.unique(clause[(symbol == INSULT) | (symbol == THREAT)]))
    table, insults, threats = grammar(), _points("insult", "target"), _points("threat")
    to, by_insult, by_threat = table.next.tolist(), insults.tolist(), threats.tolist()
    waits = 2 + FLAGS
    out = np.zeros((len(texts), 4))
    state, last = 0, -1
    insult = threat = 2.0
    where = np.flatnonzero(hot)
    rows = zip(symbol[where].tolist(), weight[where].tolist(), clause[where].tolist(), tokens.doc[where].tolist(), strict=True)
    found: dict[int, list] = {}
    for s, w, c, d in rows:
        if c != last:
            state, last = 0, c
            found[c] = [d, 0.0]
        new = to[state][s]
        # the scorers' states are the last parts of the table's: threat, then target
        if s == INSULT:
            insult = _waiting(state % waits, new % waits, insult, w)
            found[c][1] += by_insult[state][s] * w
        elif s == THREAT:
            threat = _waiting(state // waits % waits, new // waits % waits, threat, w)
            found[c][1] += by_threat[state][s] * w
        elif s == TARGET:
            found[c][1] += by_insult[state][s] * insult + by_threat[state][s] * threat
        state = new
    for d, points in found.values():
        if points > 0:
            out[d, 0] += points
            out[d, 1] = max(out[d, 1], points)
            out[d, 2] += 1
    out[:, 3] = 100 * out[:, 2] / np.maximum(tokens.words.counts, 1)
    return out


def _waiting(was: int, now: int, weight: float, new: float) -> float:
    """The weight of what waits for a target, after one more symbol: the new one's if it waits in the other's place, the larger of two alike."""
    if now < 2 or was < 2 or was != now:
        return new
    return max(weight, new)


@lru_cache(4)
def _points(*scorers: str) -> np.ndarray:
    """The points of the grammar's table that come from some of its scorers."""
    t = transducers()
    for name in {"insult", "threat", "target"} - set(scorers):
        t[name].points[:] = 0
    return t["negation"].beside(t["reported"]).into(t["insult"].beside(t["threat"]).beside(t["target"])).points


def _design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.log1p(x[:, 0]), x[:, 1], np.log1p(x[:, 2]), np.minimum(x[:, 3], 10), x[:, 0] > 0])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, fit_rows: int = FIT_ROWS) -> tuple[dict, np.ndarray]:
    """Stems and the weights of the last step (logistic), from at most fit_rows labelled texts outside the held-out fold, those with the smallest hashes of doc_id.

    A doc_id counts once, however many rows it has: as toxic if any label says so, with the text of the smallest hash. Null labels and ids
    don't take part, null texts count as empty ones. With no text of one of the two kinds, as in empty tables, there are no stems and fixed weights.
    """
    known = labels.where("toxic is not null").where(fold(F.col("doc_id"), folds) != held).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = known.join(F.broadcast(sampled_ids(known, 5, fit_rows)), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = texts_of(docs, chosen).select("text", "toxic").cache()
    # two halves: stems come from the first, the last step from the second, where they are as rare as in new texts
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    stems = learn_stems(rows.where(half == 0))
    second = clause_rows(rows.where(half == 1), stems).toPandas()
    x, y = np.array(second["x"].tolist(), float).reshape(-1, 4), second["toxic"].to_numpy(float)
    weights = np.array([-3.0, 1.0, 0.1, 0.5, 0.1, 1.0])
    if len(y) and 0 < y.mean() < 1:
        design = _design(x)
        for _ in range(30):  # Newton's steps
            p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
            hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(len(weights))
            weights = weights - np.linalg.solve(hessian, design.T @ (p - y) + 0.1 * weights)
    stems = learn_stems(rows)
    rows.unpersist()
    return stems, weights


def clause_rows(rows: DataFrame, stems: dict) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_pieces(batch.column(0)):
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(list(clause_scores(texts, stems)), pa.list_(pa.float64()))], names=["toxic", "x"])

    return in_python(rows.select("text", "toxic"), run, "toxic int, x array<double>")


def score_toxicity(docs: DataFrame, stems: dict, weights: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= threshold) and clauses (how many scored) of every row.

    Words become symbols (insult, threat, target, negation, report, other); clauses end at
    punctuation, at the end of a line and of a text, and the composed transducer runs over each clause
    with an insult or a threat. Null and empty texts have no clause and get the lowest score. Equal rows get equal scores,
    a null doc_id is kept, an empty table gives no rows. Row by row,
    without a shuffle, over whole texts; columns other than doc_id and text are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_pieces(batch.column(1)):
                x = clause_scores(texts, stems)
                score = 1 / (1 + np.exp(-np.clip(_design(x) @ weights, -30, 30)))
                columns = [batch.column(0).slice(a, b - a), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(x[:, 2].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted", "clauses"])

    schema = StructType().add("doc_id", "long").add("score", DoubleType()).add("predicted", IntegerType()).add("clauses", "long")
    return in_python(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)
