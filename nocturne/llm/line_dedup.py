"""Line dedup by an exact set-similarity join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILE, PLACE, ROW, Batches, apart, beside, cells_of, cleared, dropped, in_cells, in_python, key_groups, placed, staged
from .textarrays import NEAR, Words, mix, pieces, text_pieces

#: Least Jaccard similarity of two lines' word sets: 4/5.
NUMERATOR, DENOMINATOR = 4, 5
#: Bits of the table of word frequencies, which tasks get whole.
RARITY_BITS = 17
#: Lines that meet at one word in one task; more are dealt out over several.
CROWD = 20_000
#: Stands for a null doc_id, which comes before all others.
NO_ID = -(1 << 63)
LINES = f"doc long, {FILE} long, {ROW} long, line int, s1 long, s2 long, s3 long, n int, prefix array<int>"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


class _Sets:
    """Distinct words of each line that has any: line (of .doc and .number) and word, sorted by line and from the rarest word on.

    A word is 48 bits of its hash, of which the first ones are replaced by their bucket's rank from rare to frequent.
    """

    def __init__(self, texts: list, rank: np.ndarray):
        w = Words(texts)
        start, _, doc = w.lines()
        first = np.searchsorted(doc, np.arange(w.n))
        of = np.searchsorted(start, w.start, side="right") - 1
        word = (rank[_bucket(w.key)] << np.uint64(31)) | ((w.key >> np.uint64(16)) & np.uint64((1 << 31) - 1))
        if len(start) < 1 << 16:
            both = np.sort((of.astype(np.uint64) << np.uint64(48)) | word)
            line, word = (both >> np.uint64(48)).astype(np.int64), both & np.uint64((1 << 48) - 1)
        else:
            order = np.lexsort((word, of))
            line, word = of[order], word[order]
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (word[1:] != word[:-1])
        self.line, self.word = line[new], word[new]
        begin = np.ones(len(self.line), bool)
        begin[1:] = self.line[1:] != self.line[:-1]
        self.begin = np.flatnonzero(begin)
        self.size = np.diff(np.append(self.begin, len(self.line)))
        which = self.line[self.begin]
        self.doc, self.number = doc[which], which - first[doc[which]]

    def signatures(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A hash of each set, and, in two columns, the parities of how many of its words fall on each of 128 places.

        Sets differ in at least as many words as their parities do.
        """
        if not len(self.begin):
            return (np.zeros(0, np.int64),) * 3
        place = mix(self.word ^ np.uint64(0x5BE0CD19137E2179)) >> np.uint64(57)
        bit = np.uint64(1) << (place & np.uint64(63))
        parts = (np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) == k, bit, np.uint64(0)), self.begin).view(np.int64) for k in range(2))
        return np.add.reduceat(mix(self.word), self.begin).view(np.int64), *parts


def _bucket(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def word_rarity(docs: DataFrame) -> np.ndarray:
    """The rank of each bucket of word hashes, from the rarest words on, over all documents; a table of one fixed size at any scale."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            for _, _, texts in text_pieces(batch.column(0), NEAR):
                total += np.bincount(_bucket(Words(texts).key), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    rows = in_python(docs, count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(1 << RARITY_BITS, np.int64)
    total[rows["bucket"].to_numpy(int)] = rows["n"]
    rank = np.empty(len(total), np.uint64)
    rank[np.argsort(total, kind="stable")] = np.arange(len(total), dtype=np.uint64)
    return rank


def _lines(docs: DataFrame, rank: Broadcast) -> DataFrame:
    """LINES of docs (doc, PLACE, text): each line with a word, and of the first of equal sets nearby the prefix too."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, *place = (batch.column(c) for c in range(3))
            for a, _, texts in text_pieces(batch.column(3), NEAR):
                s = _Sets(texts, rank.value)
                s1, s2, s3 = s.signatures()
                at = np.arange(len(s.line)) - np.repeat(s.begin, s.size)
                longest = s.size - (NUMERATOR * s.size + DENOMINATOR - 1) // DENOMINATOR + 1
                longest = np.where((DENOMINATOR - NUMERATOR) * s.size < NUMERATOR, 0, longest)  # so few words have no other partner than their equals
                order = np.argsort(s1, kind="stable")
                longest[order[1:][s1[order][1:] == s1[order][:-1]]] = 0  # the first of equal sets is enough
                words = s.word[at < np.repeat(longest, s.size)]
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(longest)]).astype(np.int32)), pa.array((words & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))
                of = pa.array(a + s.doc)
                columns = [ids.take(of), *(c.take(of) for c in place), pa.array(s.number.astype(np.int32)), pa.array(s1), pa.array(s2), pa.array(s3), pa.array(s.size.astype(np.int32)), prefix]
                yield pa.RecordBatch.from_arrays(columns, names=_names(LINES))

    return in_python(docs, run, LINES)


def _possible(n: np.ndarray, pos: np.ndarray, s2: np.ndarray, s3: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sizes, places of the shared word and parities allow the similarity of rows i and j."""
    a, b = n[i], n[j]
    fits = (DENOMINATOR * a >= NUMERATOR * b) & (DENOMINATOR * b >= NUMERATOR * a)
    fits &= (NUMERATOR + DENOMINATOR) * np.minimum(a - pos[i], b - pos[j]) >= NUMERATOR * (a + b)
    # sets with this overlap differ in a ninth of their words at most
    some = np.flatnonzero(fits)
    i, j = i[some], j[some]
    apart_ = np.bitwise_count(s2[i] ^ s2[j]).astype(np.int64) + np.bitwise_count(s3[i] ^ s3[j])
    fits[some] = (NUMERATOR + DENOMINATOR) * apart_ <= (DENOMINATOR - NUMERATOR) * (a + b)[some]
    return fits


class _Meeting:
    """Rows in order of word and cell, as arrays: each row's word, cell, part, size, place of the word, parities, and the first row it meets."""

    def __init__(self, rows: pa.Table, once: bool):
        self.rows = rows
        self.s1, self.s2, self.word, both = (rows.column(c).to_numpy() for c in ("s1", "s2", "word", "both"))
        self.s3 = rows.column("s3").to_numpy()
        self.cell, self.part = cells_of(rows)
        self.cut = "cell" in rows.schema.names
        if once:  # equal sets that came from several places
            # what is equal in all of them stands together by their sum too
            order = np.argsort(self.s1 + self.s2 + self.word * np.int64(0x2545F4914F6CDD1D) + self.cell, kind="stable")
            again = np.ones(max(0, len(order) - 1), bool)
            for value in (self.word, self.cell, self.s1, self.s2):
                again &= value[order][1:] == value[order][:-1]
            keep = np.sort(order[np.concatenate([[True], ~again])]) if len(order) else order
            for name in ("s1", "s2", "s3", "word", "cell", "part"):
                setattr(self, name, getattr(self, name)[keep])
            both = both[keep]
        self.n, self.pos = both >> 32, both & 0xFFFFFFFF
        new = np.ones(len(both), bool)
        new[1:] = (self.word[1:] != self.word[:-1]) | (self.cell[1:] != self.cell[:-1])
        self.begin = np.maximum.accumulate(np.where(new, np.arange(len(both)), 0))

    def possible_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows i and j < i of one word and cell that may be similar: each row against the first, second, third row there."""
        s2, s3 = self.s2.view(np.uint64), self.s3.view(np.uint64)
        active, k = np.flatnonzero(self.begin < np.arange(len(self.begin))), 0
        while len(active):
            j = self.begin[active] + k
            fits = _possible(self.n, self.pos, s2, s3, active, j)
            if self.cut:
                fits &= apart(self.cell, self.part, active, j)
            if fits.any():
                yield active[fits], j[fits]
            k += 1
            active = active[self.begin[active] + k < active]


#: Rows that meet have these in common; the cell only where a crowded word was cut.
MEET_BY = ["word", "cell"]
MEETING = "s1 long, s2 long, word int, pos int"
#: So many pairs are compared at a time at most, as their numbers and a word fit in 64 bits, and fewer if they have so many words.
COMPARED, COMPARED_WORDS = 1 << 14, 1 << 17
#: Bytes of a word.
WORD_BYTES = 6
LINKS = "s1 long, s2 long, links long, later boolean"


def _meeting(batches: Batches) -> Batches:
    """The postings that may be similar to another one of their word, from postings in order of word and cell."""
    for rows, _ in key_groups(((None, b) for b in batches if b.num_rows), MEET_BY, rows=60_000):
        m = _Meeting(rows, once=True)
        meets = np.zeros(len(m.word), bool)
        for i, j in m.possible_pairs():
            meets[i] = meets[j] = True
        yield pa.RecordBatch.from_arrays([pa.array(x[meets]) for x in (m.s1, m.s2, m.word, m.pos.astype(np.int32))], names=_names(MEETING))


def _similar_here(word: np.ndarray, n: np.ndarray, start: np.ndarray, words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j are similar by all their words, and the word that they meet by is the first that both have: so a pair counts once."""
    side = np.stack([i, j], 1).ravel()
    size = n[side]
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[side], size)
    both = np.sort((np.repeat(np.arange(len(side)) // 2, size).astype(np.uint64) << np.uint64(48)) | words[at])
    common = both[1:][both[1:] == both[:-1]]
    of = (common >> np.uint64(48)).astype(np.int64)
    overlap = np.bincount(of, minlength=len(i))
    alike = np.zeros(len(i), bool)
    least = np.flatnonzero(np.diff(of, prepend=-1))
    pair = of[least]
    alike[pair] = (common[least] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) == word[i[pair]]
    return alike & ((NUMERATOR + DENOMINATOR) * overlap >= NUMERATOR * (n[i] + n[j]))


def _count_links(batches: Batches) -> Batches:
    """links (the sets that a set is similar to) and later (one of them stands before it), of postings with all words in order of word, cell and place.

    Only counts leave the task, however many pairs a group of near copies has.
    """
    for rows, _ in key_groups(((None, b) for b in batches if b.num_rows), MEET_BY, rows=20_000):
        m = _Meeting(rows, once=False)
        packed = np.frombuffer(b"".join(rows.column("words").to_pylist()), np.uint8).reshape(-1, WORD_BYTES)
        words = np.pad(packed, ((0, 0), (0, 8 - WORD_BYTES))).view("<u8").ravel()
        start = np.cumsum(m.n) - m.n
        links, later = np.zeros(len(m.word), np.int64), np.zeros(len(m.word), bool)
        held, size = [], 0

        def settle() -> None:
            i, j = np.concatenate(held, axis=1)
            ends, b = np.cumsum(m.n[i] + m.n[j]), 0  # noqa: B023
            while b < len(i):
                a, b = b, max(b + 1, min(b + COMPARED, int(np.searchsorted(ends, (ends[b - 1] if b else 0) + COMPARED_WORDS))))
                x, y = i[a:b], j[a:b]
                alike = _similar_here(m.word, m.n, start, words, x, y)  # noqa: B023
                x, y = x[alike], y[alike]
                np.add.at(links, np.concatenate([x, y]), 1)  # noqa: B023
                later[x] = True  # noqa: B023

        for i, j in m.possible_pairs():
            held.append(np.stack([i, j]))
            size += len(i)
            if size >= COMPARED:
                settle()
                held, size = [], 0
        if held:
            settle()
        some = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (m.s1, m.s2, links, later)], names=_names(LINKS))


FULL = f"doc long, {FILE} long, {ROW} long, line int, s1 long, s2 long, s3 long, n int, words binary, meets array<struct<word:int,pos:int>>"


def _full_sets(docs: DataFrame, wanted: DataFrame, rank: Broadcast) -> DataFrame:
    """The lines in wanted (PLACE, line, meets) with all their words, from the texts where they are read."""
    per_doc = wanted.groupBy(*PLACE).agg(F.collect_list(F.struct("line", "meets")).alias("parts"))
    meeting = pa.list_(pa.struct([("word", pa.int32()), ("pos", pa.int32())]))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("parts")))
            some, of, numbers, meets = [], [], [], []
            for k, (text, parts) in enumerate(zip(batch.column("text").to_pylist(), batch.column("parts").to_pylist(), strict=True)):
                every = text.split("\n")
                for p in parts:
                    some.append(every[p["line"]])
                    of.append(k)
                    numbers.append(p["line"])
                    meets.append(p["meets"])
            for a, b in pieces(some, NEAR):
                s = _Sets(some[a:b], rank.value)
                packed = s.word.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]
                words = [packed[x : x + k].tobytes() for x, k in zip(s.begin.tolist(), s.size.tolist(), strict=True)]
                at = [a + d for d in s.doc.tolist()]
                rows = pa.array([of[x] for x in at], pa.int64())
                columns = [*(batch.column(c).take(rows) for c in ("doc", *PLACE)), pa.array([numbers[x] for x in at], pa.int32()), *map(pa.array, s.signatures()), pa.array(s.size.astype(np.int32)), pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([meets[x] for x in at], meeting)], names=["doc", *PLACE, "line", "s1", "s2", "s3", "n", "words", "meets"])

    return beside(docs, per_doc, run, FULL)


def _dealt(postings: DataFrame, *order: str) -> DataFrame:
    """postings (s1, s2, s3, word, both) by word, a crowded one over several cells, in order."""
    rows = in_cells(postings, "word", ["s1", "s2"], CROWD)
    by = [c for c in MEET_BY if c in rows.columns]
    return rows.repartition(*by).sortWithinPartitions(*by, *order)


def _sets_told(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines with a word of docs (doc, PLACE, text), and, of each set that other lines have too or that is similar to another set, its first line, links and whether it goes."""
    rank = docs.sparkSession.sparkContext.broadcast(word_rarity(docs.select("text")))
    lines = staged(_lines(docs, rank), "lines")
    first = F.min(F.struct("doc", *PLACE, "line")).alias("first")
    heads = staged(lines.groupBy("s1", "s2").agg(first, F.count(F.lit(1)).alias("many")).select("s1", "s2", "first.*", "many"), "line-heads")
    both = lambda n, pos: (F.shiftleft(F.col(n).cast("long"), 32) + F.col(pos)).alias("both")
    postings = lines.where(F.size("prefix") > 0).select("s1", "s2", "s3", "n", F.posexplode("prefix").alias("pos", "word"))
    meeting = _dealt(postings.select("s1", "s2", "s3", "word", both("n", "pos"))).mapInArrow(_meeting, MEETING)
    meets = meeting.groupBy("s1", "s2").agg(F.collect_set(F.struct("word", "pos")).alias("meets"))
    full = staged(_full_sets(docs, heads.join(meets, ["s1", "s2"]).select(*PLACE, "line", "meets"), rank), "line-sets")
    place = ("doc", *PLACE, "line")
    counted = full.select(*place, "s1", "s2", "s3", "n", "words", F.inline("meets")).select(*place, "s1", "s2", "s3", "word", both("n", "pos"), "words")
    counts = _dealt(counted, *place).mapInArrow(_count_links, LINKS)
    linked = staged(counts.groupBy("s1", "s2").agg(F.sum("links").alias("links"), F.max("later").alias("later")), "line-links")
    dropped(full)
    cleared(docs.sparkSession)
    told = heads.join(linked, ["s1", "s2"], "left").where("many > 1 OR links IS NOT NULL")
    later, links = F.coalesce("later", F.lit(False)).alias("_later"), F.coalesce("links", F.lit(0)).alias("_links")
    return lines, staged(told.select("s1", "s2", *(F.col(c).alias(f"_{c}") for c in place), links, later), "line-told")


def linked_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc, PLACE, text): all lines with a word, and those with an equal or a similar one: doc, PLACE, line, links (the other sets of Jaccard
    similarity 4/5 or more), equal (its set stood before) and removed.

    Sets meet by every word of their prefixes, first with their parities; those that may be similar to any
    other meet again with all their words, and each pair is counted at the first word that both have.
    """
    lines, told = _sets_told(docs)
    place = ("doc", *PLACE, "line")
    equal = F.lit(False)
    for c in place:
        equal = equal | (F.col(c) != F.col(f"_{c}"))
    # told is written, so Spark can split a line with very many copies
    found = lines.select(*place, "s1", "s2").join(told, ["s1", "s2"])
    return lines, found.select(*place, F.col("_links").alias("links"), equal.alias("equal"), (equal | F.col("_later")).alias("removed"))


def _narrowed(docs: DataFrame) -> DataFrame:
    return placed(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), *PLACE, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def line_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines (lines with a word), n_removed, n_equal, n_links and removed (their numbers, from 0).

    A line's words are a set. A line goes if a line before it, in order of doc_id, place of the row and line number,
    has a set of Jaccard similarity 4/5 or more. Lines with equal sets enter the join once; n_equal counts the lines
    that go because an equal set stood before. n_links sums, over a document's lines, the other sets that are similar.

    The join is exact and whole: words are ordered by how rare they are, two similar lines share a word among the first
    few of each, and all pairs that lengths, places and parities leave are checked by all their words' hashes. Pairs
    are counted where they meet and never written, but a group of near copies is compared pair by pair; a word with very many
    lines is dealt out over several tasks.

    A null text has no lines, and lines without a word are neither counted nor removed. Rows with the same doc_id
    are documents of their own, one after the other as they stand in the files; a null doc_id comes before all others. An empty table gives no rows;
    columns other than doc_id and text are ignored.
    """
    rows = placed(docs)
    lines, found = linked_lines(_narrowed(rows))
    counts = lines.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n_lines"))
    marks = found.groupBy(*PLACE).agg(
        F.sum(F.col("removed").cast("long")).alias("n_removed"),
        F.sum(F.col("equal").cast("long")).alias("n_equal"),
        F.sum("links").alias("n_links"),
        F.array_sort(F.collect_set(F.when(F.col("removed"), F.col("line")))).alias("removed"),
    )
    every = rows.select(F.col("doc_id").cast("long").alias("doc_id"), *PLACE).join(counts, list(PLACE), "left").join(marks, list(PLACE), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.select("doc_id", count("n_lines"), count("n_removed"), count("n_equal"), count("n_links"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines that line_report() removes cut out of text; documents that lose all their words go.

    Other columns stay. Documents that lose nothing, null and empty texts among them, stay as they are. Equal rows, and others with the
    same doc_id, are documents of their own: the first in its file keeps its lines. An empty table gives none.
    Texts don't move: the numbers of the lines are told to where they are read.
    """
    rows = placed(docs)
    gone = linked_lines(_narrowed(rows))[1].where("removed").groupBy(*PLACE).agg(F.collect_list("line").alias("_nocturne_gone"))
    names = docs.columns
    at = names.index("text")

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            mask = pc.is_valid(batch.column("_nocturne_gone"))
            some = batch.filter(mask)
            texts = []
            for text, lines in zip(some.column(at).to_pylist(), some.column("_nocturne_gone").to_pylist(), strict=True):
                lines = set(lines)
                texts.append("\n".join(x for k, x in enumerate(text.split("\n")) if k not in lines))
            kept = batch.select(names)
            if texts:
                whole = pc.replace_with_mask(kept.column(at), mask, pa.array(texts, kept.column(at).type))
                kept = kept.set_column(at, kept.schema.field(at), whole)
                left = np.ones(len(kept), bool)
                left[mask.to_numpy(zero_copy_only=False)] = [bool(t.strip(" \t\n\v\f\r")) for t in texts]
                kept = kept.filter(pa.array(left))
            yield kept

    return beside(rows, gone, cut, rows.select(names).schema)


#: The same with every shared word as a candidate.
SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
  FROM documents WHERE text IS NOT NULL),
sets AS (
  SELECT doc_id, line, list_sort(list_distinct(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))) AS words FROM lines
  WHERE regexp_matches(t, '[^\\x20\\x09-\\x0D]')),
classes AS (SELECT words, len(words) AS n, min(doc_id * 1000000 + line) AS head FROM sets GROUP BY words),
tokens AS (SELECT head, n, words, unnest(words) AS word FROM classes WHERE n >= 4),
rarity AS (SELECT word, count(*) AS times FROM tokens GROUP BY word),
prefix AS (
  SELECT * FROM (
    SELECT t.head, t.n, t.words, t.word, row_number() OVER (PARTITION BY t.head ORDER BY r.times, t.word) AS k
    FROM tokens t JOIN rarity r USING (word))
  WHERE k <= n - (4 * n + 4) // 5 + 1),
pairs AS (
  SELECT DISTINCT a.head AS x, b.head AS y, a.words AS wx, b.words AS wy
  FROM prefix a JOIN prefix b ON a.word = b.word AND a.head < b.head AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
links AS (SELECT x, y FROM pairs WHERE 9 * len(list_intersect(wx, wy)) >= 4 * (len(wx) + len(wy))),
ends AS (SELECT x AS head, 0 AS later FROM links UNION ALL SELECT y, 1 FROM links),
linked AS (SELECT head, count(*) AS links, max(later) AS later FROM ends GROUP BY head),
told AS (
  SELECT s.doc_id, s.line, coalesce(l.links, 0) AS links, s.doc_id * 1000000 + s.line <> c.head AS equal,
         coalesce(l.later, 0) = 1 OR s.doc_id * 1000000 + s.line <> c.head AS removed
  FROM sets s JOIN classes c ON s.words = c.words LEFT JOIN linked l ON l.head = c.head),
per_doc AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE removed) AS n_removed, count(*) FILTER (WHERE equal) AS n_equal, sum(links) AS n_links,
         list(CAST(line AS INTEGER) ORDER BY line) FILTER (WHERE removed) AS removed FROM told GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(p.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(p.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(p.n_equal, 0) AS BIGINT) AS n_equal, CAST(coalesce(p.n_links, 0) AS BIGINT) AS n_links, coalesce(p.removed, CAST([] AS INTEGER[])) AS removed
FROM documents d LEFT JOIN per_doc p USING (doc_id)
"""
