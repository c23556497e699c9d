"""Packing documents into sequences: linear grouping, configurations, best fit."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, held_by_worker, in_python, ranked, spread, staged

CAPACITY = 4096
END_ID = 1
#: Words whose ids a worker remembers.
REMEMBERED = 150_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: What byte-level tokenizers write for each byte: itself where it prints, else the next character from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTER = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}


class WordEncoder:
    """Ids of a text, from a tokenizer that works word by word.

    Its normaliser maps white space to spaces and its pre-tokenizer drops them, so the ids
    of a text are those of its words in a row; most words come again and are looked up.
    A word of Latin letters, with or without signs after them, is told apart here; the tokenizer
    does all others.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}
        # letters up to U+024F, the precomposed Latin ones, then ASCII signs but the apostrophe
        self.plain = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u024f]*)([!-&(-/:-@\\[-`{-~]*)").fullmatch

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= REMEMBERED:
                self.parts = {"": b""}
            letters = part if part.isascii() else "".join(_LETTER[b] for b in part.encode())
            self.parts[part] = found = np.array([token.id for token in self.tokenizer.model.tokenize(letters)], "<u4").tobytes()
        return found

    def _word(self, word: str) -> bytes:
        if m := self.plain(word):
            out = self._part(m[1].lower()) + self._part(m[2])
        else:
            out = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = out
        return out

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        known, out = self.known, []
        # Python also splits at these four, which are no white space to the tokenizer
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        for word in re.findall("[^ \\t\\n\\r]+", text) if odd else text.split():
            found = known.get(word)
            out.append(self._word(word) if found is None else found)
        return b"".join(out)


@held_by_worker
def encoder(path: str) -> WordEncoder:
    """One for each worker, which keeps its words from task to task of this stage."""
    return WordEncoder(path)


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of each document's ids, at most capacity long each, with end_id after the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(encode(text or "") + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(rows, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return in_python(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, PIECES)


def configurations(sizes: list[int], wanted: list[int], capacity: int) -> list[tuple[tuple[int, ...], float]]:
    """How often each way to fill a sequence with few sizes is used, by column generation.

    A way is a number for each size. The linear programme min sum x, A x = wanted, x >= 0
    starts from ways of one size; a knapsack over the duals gives the next way, until none helps.
    """
    k = len(sizes)
    basis = [tuple(capacity // s if i == j else 0 for j in range(k)) for i, s in enumerate(sizes)]
    goal = np.array(wanted, float)
    size = np.array(sizes)
    for _ in range(400):
        matrix = np.array(basis, float).T
        inverse = np.linalg.inv(matrix)
        x, dual = inverse @ goal, inverse.sum(axis=0)
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(1, capacity + 1):
            fits = size <= room
            best[room] = best[room - 1]
            if fits.any():
                value = np.where(fits, dual + best[np.maximum(room - size, 0)], -1)
                if value.max() > best[room] + 1e-12:
                    best[room], choice[room] = value.max(), value.argmax()
        if best[capacity] <= 1 + 1e-9:
            break
        way, room = [0] * k, capacity
        while room > 0:
            if choice[room] < 0:
                room -= 1
            else:
                way[choice[room]] += 1
                room -= sizes[choice[room]]
        step = inverse @ np.array(way, float)
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[out] = tuple(way)
        if abs(np.linalg.det(np.array(basis, float))) < 1e-9:
            break
    return [(way, float(n)) for way, n in zip(basis, x, strict=True) if n >= 1]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 32, unit: int = 8) -> np.ndarray:
    """Where the pieces of each length go; counts has how many there are.

    Rows: length, first (rank of the first piece among those of this length), n, sequence,
    offset, times. Pieces first to first + n - 1 go into the sequences from `sequence` on, `times`
    into each, one after the other from offset on. All work is on lengths, of which there
    are at most `capacity`, so the plan's size and time don't grow with the number of pieces.

    Lengths over an eighth of the capacity are put in groups of equal number and rounded up to the
    group's largest (and to a multiple of unit); configurations() is solved for these few sizes, and
    the real lengths take the places. What is left over and the small ones go, longest first, each
    into the fullest sequence that has room for it.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    done: list[tuple[tuple[tuple[int, int], ...], int]] = []
    rooms: dict[int, list] = defaultdict(list)
    if capacity in left:
        done.append((((capacity, 1),), left.pop(capacity)))
    large = sorted((n for n in left if n > capacity // 8), reverse=True)
    total = sum(left[n] for n in large)
    runs: list[list[list[int]]] = []  # of each group: length and number, longest first
    room = 0
    for n in large:
        c = left.pop(n)
        while c:
            if not room:
                runs.append([])
                room = -(-total // groups)
            take = min(c, room)
            runs[-1].append([n, take])
            c, room = c - take, room - take
    if runs:
        sizes = [-(-r[0][0] // unit) for r in runs]
        have = [sum(c for _, c in r) for r in runs]
        for way, x in sorted(configurations(sizes, have, capacity // unit), key=lambda w: -w[1]):
            x = min([int(x), *(have[g] // m for g, m in enumerate(way) if m)])
            if x <= 0:
                continue
            slots = []
            for g, m in enumerate(way):
                have[g] -= m * x
                for _ in range(m):
                    slot, need = [], x
                    while need:
                        n, c = runs[g][-1]
                        take = min(c, need)
                        slot.append([n, take])
                        need -= take
                        runs[g][-1][1] -= take
                        if not runs[g][-1][1]:
                            runs[g].pop()
                    slots.append(slot)
            while slots[0]:
                t = min(s[-1][1] for s in slots)
                recipe = tuple((s[-1][0], 1) for s in slots)
                insort(rooms[capacity - sum(n for n, _ in recipe)], (recipe, t))
                for s in slots:
                    s[-1][1] -= t
                    if not s[-1][1]:
                        s.pop()
        for r in runs:
            for n, c in r:
                left[n] = left.get(n, 0) + c
    free = sorted(rooms)
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            at = bisect_left(free, n)
            if at == len(free):
                m = capacity // n
                for times, many in ((m, c // m), (c % m, 1)):
                    if times and many:
                        r = capacity - times * n
                        if not rooms[r]:
                            insort(free, r)
                        rooms[r].append((((n, times),), many))
                break
            r = free[at]
            recipe, many = rooms[r].pop()
            m = r // n
            full = min(many, c // m)
            parts = [(full, m)] + ([(1, c % m)] if full < many and full == c // m and c % m else [])
            for bins, times in parts:
                if bins:
                    rest = r - times * n
                    if not rooms[rest] and rest != r:
                        insort(free, rest)
                    rooms[rest].append((recipe + ((n, times),), bins))
                    c -= bins * times
                    many -= bins
            if many:
                rooms[r].append((recipe, many))
            elif not rooms[r]:
                free.remove(r)
    done += [x for r in sorted(rooms) for x in rooms[r]]
    rows, sequence, rank = [], 0, defaultdict(int)
    for recipe, many in done:
        offset = 0
        for n, times in recipe:
            rows.append((n, rank[n], many * times, sequence, offset, times))
            rank[n] += many * times
            offset += n * times
        sequence += many
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset."""
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # a row per length: capacity rows at most
    steps, buckets = plan(counts, capacity), bucket_count(max(counts.values(), default=0))
    shared = pieces.sparkSession.sparkContext.broadcast(steps)
    # doc_id alone would keep the pieces of one long document together
    bucket = spread(F.coalesce(F.col("doc_id"), F.lit(0)) % 1_000_000_007 * 31 + F.col("piece"), buckets).cast("int")
    numbered = ranked(pieces.withColumn("_bucket", bucket), ["length"], ["_bucket"], ["doc_id", "piece", "start", "ids_crc32"], "_rank").drop("_bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        key = rows[:, 0] * (1 << 48) + rows[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            of = rows[np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1]
            i = rank - of[:, 1]
            out = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            out += [pa.array(of[:, 3] + i // of[:, 5]), pa.array(of[:, 4] + i % of[:, 5] * length)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document with its place in a sequence of at most capacity tokens.

    A document is its ids and end_id; only longer ones are cut, every capacity tokens. The
    number of pieces of each length is all that the driver sees (capacity rows at most); it
    plans sequences by lengths, and the pieces of a length take their places by rank.

    A null or empty text is end_id alone. Equal rows are packed each. A null doc_id is kept.
    An empty table gives no rows. Columns other than doc_id and text are ignored.
    """
    return placed(staged(tokenized(docs, tokenizer, capacity, end_id), "pieces"), capacity)
