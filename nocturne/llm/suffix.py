"""Repeated passages by longest previous factors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLACE, Batches, beside, cleared, key_groups, placed, staged
from .textarrays import mix, text_pieces

#: Bytes of an anchor: a power of two.
ANCHOR = 16
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _doubled(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width values (a power of two), from hashes of runs of half the width."""
    factor, step = _FACTOR, 1
    while step < width:
        values = values[:-step] * factor + values[step:]
        with np.errstate(over="ignore"):
            factor = factor * factor
        step *= 2
    return values


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the first smallest of each width values in a row stands."""
    at, low, have = np.arange(len(values), dtype=np.int32), values, 1
    while have < width:
        step = min(have, width - have)
        take = low[:-step] <= low[step:]
        at, low = np.where(take, at[:-step], at[step:]), np.where(take, low[:-step], low[step:])
        have += step
    return at


def anchored(data: bytes, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of length bytes that share an anchor: text, first window, windows, key, hash of all their bytes, sides.

    sides holds 16 bits of a hash of the anchor with half of a window's other bytes to its left, and 16 with as many to its
    right, 0 where no window of the run has them. Every window has one of the two whole.

    Each window's anchor is the run of ANCHOR bytes in it whose hash is the smallest, the first one
    of equals. It depends on the window's bytes alone, so equal windows have equal
    anchors, wherever they stand. Windows don't cross the bounds between texts.
    """
    size = len(data)
    none = np.zeros(0, np.int64)
    if size < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none
    raw = mix(np.frombuffer(data, np.uint8))
    keys = mix(_doubled(raw, ANCHOR))
    anchor = _leftmost_least(keys, length - ANCHOR + 1)
    start = np.arange(size - length + 1)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(start)]
    inside = start + length <= bounds[doc + 1]
    start, doc, anchor = start[inside], doc[inside], anchor[inside]
    if not len(start):
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(start)))
    begin = start[first]
    # the sums of a mixed rolling hash over all bytes of a run
    scale = np.cumprod(np.full(size, _FACTOR, np.uint64), dtype=np.uint64)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(raw * scale, out=total[1:], dtype=np.uint64)
    back = np.cumprod(np.full(size, np.uint64(pow(int(_FACTOR), -1, 1 << 64)), np.uint64), dtype=np.uint64)
    whole = mix((total[begin + many - 1 + length] - total[begin]) * back[begin] + many.astype(np.uint64))
    at, half = anchor[first].astype(np.int64), (length - ANCHOR + 1) // 2
    sides = np.zeros(len(begin), np.int64)
    for shift, a, b, there in ((16, at - half, at + ANCHOR, begin <= at - half), (0, at, at + ANCHOR + half, begin + many - 1 + length >= at + ANCHOR + half)):
        a, b = a[there], b[there]
        sides[there] |= ((mix((total[b] - total[a]) * back[a]) >> np.uint64(48)).astype(np.int64) | 1) << shift
    return doc[first], begin - bounds[doc[first]], many, keys[at], whole, sides


def _suffix_ranks(data: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """For runs of 8, 16, 32, ... bytes: the rank of what each place starts with, cut at end, the place where its context ends.

    The last ranks are those of whole suffixes. Two places of one rank start with equal bytes, and end equally far on if they end before.
    """
    n = len(end)
    left = np.minimum(end - np.arange(n), 8)
    word = np.zeros(n, np.uint64)
    for b in range(8):
        word = (word << np.uint64(8)) | np.where(b < left, data[b : b + n], 0).astype(np.uint64)
    longest = int((end - np.arange(n)).max(initial=0))
    ranks, widths = [_rank(np.unique(word, return_inverse=True)[1], left)], [8]
    while widths[-1] < longest:
        step = widths[-1]
        beyond = np.arange(n) + step
        follows = beyond < end
        ranks.append(_rank(ranks[-1], np.where(follows, ranks[-1][np.minimum(beyond, n - 1)] + 1, 0)))
        widths.append(2 * step)
    return ranks, widths


def _rank(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Each pair's place among the distinct pairs, in order; both are numbers from 0 on, of which there are few more than pairs."""
    return np.unique(first * (second.max(initial=0) + 1) + second, return_inverse=True)[1]


def _common(data: np.ndarray, end: np.ndarray, ranks: list[np.ndarray], widths: list[int], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes the places a and b start with in common, before either context ends."""
    a_end, b_end, a, b, out = end[a], end[b], a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for rank, width in zip(ranks[::-1], widths[::-1], strict=True):
        going = np.flatnonzero((a + width <= a_end) & (b + width <= b_end))
        going = going[rank[a[going]] == rank[b[going]]]
        for x in (a, b, out):
            x[going] += width
    room = np.minimum(a_end - a, b_end - b)
    alike = np.ones(len(a), bool)
    for k in range(8):  # fewer than eight bytes are left, or they differ
        alike &= (k < room) & (data[np.minimum(a + k, len(data) - 1)] == data[np.minimum(b + k, len(data) - 1)])
        out += alike
    return out


def longest_previous_factors(contexts: list[bytes], docs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place that starts a run of least bytes in its context: the context, the place in it, and the length of the longest run from
    there on that also stands in a context of a smaller doc; 0 where that is under least.

    All places are put in suffix order, with the least common prefix of neighbours. Whatever an earlier document shares is longest with the nearest
    place before or after in that order that has a smaller doc: its previous and next smaller position. Going there, the common prefix is
    the least on the way; a way on which it falls under least is given up.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    data = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    owner = np.repeat(np.arange(len(contexts)), sizes)
    end = (begin + sizes)[owner]
    ranks, widths = _suffix_ranks(data, end)
    start = np.flatnonzero(end - np.arange(len(end)) >= least)
    order = start[np.argsort(ranks[-1][start], kind="stable")]
    common = np.zeros(len(order), np.int64)
    common[1:] = _common(data, end, ranks, widths, order[1:], order[:-1])
    common[common < least] = 0
    value = docs[owner[order]]
    longest = np.zeros(len(order), np.int64)
    for turned in (False, True):
        v = value[::-1] if turned else value
        reach = np.concatenate([[0], common[1:][::-1]]) if turned else common.copy()
        near = np.arange(len(v)) - 1  # the nearest place before that may be smaller
        open_ = np.flatnonzero(reach)
        open_ = open_[v[near[open_]] >= v[open_]]
        while len(open_):
            via = near[open_]
            reach[open_] = np.minimum(reach[open_], reach[via])
            near[open_] = near[via]
            open_ = open_[reach[open_] > 0]
            open_ = open_[v[near[open_]] >= v[open_]]
        longest = np.maximum(longest, reach[::-1] if turned else reach)
    out = np.zeros(len(end), np.int64)
    out[order] = longest
    return owner[start], start - begin[owner[start]], out[start]


def previous_factors(contexts: list[bytes], docs: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context, which windows of length bytes a longest previous factor covers whole: those that also stand in a context of a smaller doc."""
    many = np.array([len(c) - length + 1 for c in contexts])
    owner, place, factor = longest_previous_factors(contexts, docs, length)
    # a factor that starts at a window and goes on covers the windows after it as well, as many as fit
    first = np.concatenate([[0], np.cumsum(many)])
    ends = np.zeros(first[-1] + 1, np.int64)
    at = first[owner] + place
    hit = factor >= length
    np.add.at(ends, at[hit], 1)
    np.add.at(ends, np.minimum(at[hit] + factor[hit] - length + 1, first[owner[hit] + 1]), -1)
    return np.split(np.cumsum(ends)[:-1] > 0, first[1:-1])


#: Rows that share a doc_id are told apart by `who`, a hash of their place; for all others it is 0.
RUNS = "key long, whole long, doc_id long, who long, at int, n int, sides int, known boolean"


def _shared_ids(rows: DataFrame) -> DataFrame:
    """PLACE and who of the rows (doc_id, PLACE) whose doc_id another row has too."""
    ids = rows.where("doc_id IS NOT NULL")
    several = staged(ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "shared-ids")
    return ids.join(several, "doc_id", "left_semi").select(*PLACE, F.xxhash64(*PLACE).bitwiseOR(F.lit(1)).alias("who"))


#: Runs that a task gathers to find equal ones among them, and rows of a batch that it hands on.
HELD_RUNS, OUT_ROWS = 1_200_000, 1 << 17


def _settled(parts: list[tuple]) -> Batches:
    """RUNS of the runs in parts, in order of key, whole and doc."""
    doc, own, at, n, key, whole, sides = (np.concatenate(c) for c in zip(*parts, strict=True))
    parts.clear()
    key = (key >> np.uint64(24)).view(np.int64)  # a key only brings runs together; 40 bits compress better
    order = np.lexsort((doc, whole, key))
    same = np.zeros(len(doc), bool)
    key, whole, doc = key[order], whole[order], doc[order]
    same[1:] = (key[1:] == key[:-1]) & (whole[1:] == whole[:-1])
    head = doc[np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))]
    columns = (key, whole.view(np.int64), doc, own[order], at[order].astype(np.int32), n[order].astype(np.int32), sides[order].astype(np.uint32).view(np.int32), doc > head)
    for a in range(0, len(doc), OUT_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + OUT_ROWS]) for c in columns], names=[x.split()[0] for x in RUNS.split(", ")])


def _runs(texts: DataFrame, shared: DataFrame, length: int) -> DataFrame:
    """The runs of all documents (doc_id, text, PLACE). known: a smaller doc of the same batch has the very same run, so it is settled."""

    def run(batches: Batches) -> Batches:
        parts, held = [], 0
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("doc_id")))
            ids, who = batch.column("doc_id").to_numpy(), batch.column("who").fill_null(0).to_numpy()
            for a, b, some in text_pieces(batch.column("text"), 1 << 20):
                texts = [t.encode("utf-8", "surrogatepass") for t in some]
                bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
                doc, *rest = anchored(b"".join(texts), bounds, length)
                parts.append((ids[a:b][doc], who[a:b][doc], *rest))
                held += len(doc)
                if held >= HELD_RUNS:
                    yield from _settled(parts)
                    parts, held = [], 0
        if parts:
            yield from _settled(parts)

    return beside(texts, shared, run, RUNS)


#: Rows of one key that are held together; a key with more is passed on without a look at the sides.
HELD_ROWS = 400_000


def _sorted_out(batches: Batches) -> Batches:
    """Of runs in order of key, whole and doc_id: kind 1, those to remove whole, and kind 2, those that may share windows with another document."""
    last = None  # key, whole and first document of rows of a key that was too large to hold
    for rows, complete in key_groups(_unknown(batches), ["key"], most=HELD_ROWS):
        if rows is None:
            yield complete
            continue
        key, whole, doc, who, at, n, sides = (rows.column(c).to_numpy() for c in ("key", "whole", "doc_id", "who", "at", "n", "sides"))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])
        head = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
        large = not complete or (last is not None and key[0] == last[0])
        if last is not None and (key[0], whole[0]) == last[:2]:
            head[: np.flatnonzero(new)[1] if new.sum() > 1 else len(head)] = last[2]
        kind = np.where(doc > head, 1, 0).astype(np.int8)
        free = np.flatnonzero(kind == 0)
        if large:
            kind[free] = 2
        else:
            for part in (sides[free] >> 16 & 0xFFFF, sides[free] & 0xFFFF):
                name = mix(key[free].view(np.uint64) ^ (part.astype(np.uint64) << np.uint64(44)))
                order = np.argsort(name, kind="stable")
                start = np.flatnonzero(np.concatenate([[True], name[order][1:] != name[order][:-1]])) if len(order) else order
                if len(start):
                    size = np.diff(np.append(start, len(order)))
                    several = np.minimum.reduceat(doc[free][order], start) != np.maximum.reduceat(doc[free][order], start)
                    hit = order[np.repeat(several, size)]
                    kind[free[hit[part[hit] > 0]]] = 2
        last = None if complete else (key[-1], whole[-1], head[-1])
        some = kind > 0
        yield _kinds(key[some], doc[some], who[some], at[some], n[some], kind[some])


def _unknown(batches: Batches) -> Iterator[tuple]:
    """The rows that aren't known, batch by batch, and None with the known ones of each batch as they are to come out."""
    for batch in batches:
        known = batch.column("known").to_numpy(zero_copy_only=False)
        if known.any():
            key, doc, who, at, n = (batch.column(c).to_numpy()[known] for c in ("key", "doc_id", "who", "at", "n"))
            yield _kinds(key, doc, who, at, n, np.ones(len(key), np.int8)), None
        if not known.all():
            yield None, batch.filter(pa.array(~known))


KINDS = "key long, doc_id long, who long, at int, n int, kind byte"


def _kinds(key: np.ndarray, d: np.ndarray, who: np.ndarray, at: np.ndarray, n: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    columns = (pa.array(key.astype(np.int64)), pa.array(d.astype(np.int64)), pa.array(who.astype(np.int64)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(kind))
    return pa.RecordBatch.from_arrays(list(columns), names=["key", "doc_id", "who", "at", "n", "kind"])


#: A key with more unclear runs is dealt out window by window.
CROWD = 20_000
CONTEXTS = "key long, doc_id long, who long, at int, context binary"


def _contexts(texts: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """key, doc_id, who, at and the bytes of all windows of each of runs (PLACE, key, who, at, n), from the texts where they are read."""
    per_doc = runs.groupBy(*PLACE).agg(F.collect_list(F.struct("key", "who", "at", "n")).alias("parts"))

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("parts")))
            rows: list[tuple] = []
            for doc_id, text, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "parts")), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for p in parts:
                    rows.append((p["key"], doc_id, p["who"], p["at"], data[p["at"] : p["at"] + p["n"] - 1 + length]))
            yield _context_rows(*zip(*rows, strict=True)) if rows else _context_rows(*[()] * 5)

    return beside(texts, per_doc, cut, CONTEXTS)


def _context_rows(key, doc, who, at, context) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((key, doc, who, at, context), types, strict=True)], names=[x.split()[0] for x in CONTEXTS.split(", ")])


FOUND = "doc_id long, who long, at int, n int"


def _factored(contexts: DataFrame, length: int) -> DataFrame:
    """FOUND: the windows that an earlier document has, key by key."""

    def factor(batches: Batches) -> Batches:
        for rows, _ in key_groups(((None, b) for b in batches if b.num_rows), ["key"]):
            doc, who, at = (rows.column(c).to_numpy() for c in ("doc_id", "who", "at"))
            out: list[list[int]] = [[], [], [], []]
            for i, hit in enumerate(previous_factors(rows.column("context").to_pylist(), doc, length)):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                for a, b in zip(edge[::2], edge[1::2], strict=True):
                    for column, value in zip(out, (doc[i], who[i], at[i] + a, b - a), strict=True):
                        column.append(int(value))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "who", "at", "n"])

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(factor, FOUND)


def _single_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The contexts' windows one by one, each with a hash of its bytes as key; without the bytes where a smaller document nearby has it.

    So a key of any number of contexts is dealt out over many tasks, and of a window that very many documents have, one row
    from each batch goes on.
    """

    def windows(batches: Batches) -> Batches:
        for batch in batches:
            contexts, doc, who, at = (batch.column(c).to_pylist() for c in ("context", "doc_id", "who", "at"))
            if not contexts:
                continue
            rows: list[tuple] = []
            for i, hit in enumerate(previous_factors(contexts, np.array(doc), length)):
                for k, settled in enumerate(hit.tolist()):
                    window = contexts[i][k : k + length]
                    key = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)
                    rows.append((key, doc[i], who[i], at[i] + k, None if settled else window))
            yield _context_rows(*zip(*rows, strict=True))

    return contexts.mapInArrow(windows, CONTEXTS)


def _spans(texts: DataFrame, length: int) -> DataFrame:
    """PLACE and spans (array of at and to, in bytes; they may overlap) of texts (doc_id, text, PLACE) that stand in a document with a smaller doc_id."""
    shared = staged(_shared_ids(texts.select("doc_id", *PLACE)), "shared")
    ids = texts.select("doc_id", *PLACE).where("doc_id IS NOT NULL").join(shared, list(PLACE), "left").withColumn("who", F.coalesce("who", F.lit(0)))
    runs = _runs(texts, shared, length)
    route = F.when(F.col("known"), F.xxhash64("doc_id", "at")).otherwise(F.xxhash64("key"))
    kinds = staged(runs.repartition(route).sortWithinPartitions("key", "whole", "doc_id", "at").mapInArrow(_sorted_out, KINDS), "kinds")
    cleared(texts.sparkSession)
    unclear = kinds.where("kind = 2").join(ids, ["doc_id", "who"]).select("key", "who", "at", "n", *PLACE)
    crowded = staged(kinds.where("kind = 2").groupBy("key").count().where(F.col("count") > CROWD).select("key"), "crowded")
    found = kinds.where("kind = 1").select("doc_id", "who", "at", "n")
    if crowded.isEmpty():
        found = found.unionByName(_factored(_contexts(texts, unclear, length), length))
    else:
        found = found.unionByName(_factored(_contexts(texts, unclear.join(crowded, "key", "left_anti"), length), length))
        single = staged(_single_windows(_contexts(texts, unclear.join(crowded, "key", "left_semi"), length), length), "windows")
        found = found.unionByName(single.where("context IS NULL").select("doc_id", "who", "at", F.lit(1).alias("n")))
        found = found.unionByName(_factored(single.where("context IS NOT NULL"), length))
    spans = found.groupBy("doc_id", "who").agg(F.collect_list(F.struct("at", (F.col("at") + F.col("n") - 1 + length).alias("to"))).alias("spans"))
    return ids.join(spans, ["doc_id", "who"]).select(*PLACE, "spans")


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the text that is left, as bytes) and kept_sha256.

    A byte goes if a string of length bytes that covers it also starts in a document with a
    smaller doc_id; strings are judged on the input. Windows of length bytes meet by an anchor. Runs of windows that are
    equal in all bytes stand for each other, by a hash; of those that share an anchor and half of the bytes beside it,
    the windows are put in suffix order, and the longest previous factors decide. An anchor with over CROWD such runs is dealt out window by window.

    A null text is empty. Rows of one doc_id don't match each other, and each loses what it shares with smaller ids; a row
    with a null doc_id matches nothing and is kept whole. Texts shorter than length, and
    an empty table, lose nothing. Columns other than doc_id and text are ignored. Texts don't move between tasks: spans are told to where they are read.
    """
    texts = placed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *PLACE)
    spans = _spans(texts, length)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, cuts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                kept, at, spans_, removed = [], 0, 0, 0
                for a, b in merged([(s["at"], s["to"]) for s in cuts or []]):
                    kept.append(data[at:a])
                    at, spans_, removed = b, spans_ + 1, removed + b - a
                left = b"".join([*kept, data[at:]])
                rows.append((doc_id, len(data), removed, spans_, left, hashlib.sha256(left).hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            columns = zip(*rows, strict=True) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return beside(texts, spans, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans, put together."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: The same by comparison of all strings of 50 bytes.
SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
  FROM (SELECT doc_id, h, CAST(unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS BIGINT) AS i FROM docs)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM windows) WHERE doc_id > first),
marked AS (SELECT doc_id, i, CASE WHEN i > 50 + lag(i) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS new FROM hits),
islands AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM islands GROUP BY doc_id, g),
edges AS (
  SELECT doc_id, coalesce(lag(b) OVER w, 0) AS from_, a AS to_ FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT d.doc_id, coalesce(max(s.b), 0), any_value(len(d.h)) // 2 FROM docs d LEFT JOIN spans s USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT e.doc_id, string_agg(substr(d.h, 2 * e.from_ + 1, 2 * (e.to_ - e.from_)), '' ORDER BY e.from_) AS h
  FROM edges e JOIN docs d ON e.doc_id = d.doc_id GROUP BY e.doc_id),
counts AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(c.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM docs d JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN counts c ON d.doc_id = c.doc_id
"""
