"""Byte-level BPE by a sentencepiece model made from the vocabulary: encoding, and decoding by the inverse mapping."""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import Batches, in_python

#: Pre-tokens whose ids a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 400_000, 64
#: Characters of short texts, or pre-tokens of a long one, that are held at a time.
PART = 1 << 20
#: Byte b is the character of this code point + b in a piece: none of them means anything to sentencepiece.
FIRST = 0x100
_LETTERS = {b: FIRST + b for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a file of ranks, by rank. Ranks run from 0 without a gap, and every byte is a token."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    tokens = [ranks[i] for i in range(len(ranks))]
    if not {bytes([b]) for b in range(256)} <= set(tokens):
        raise ValueError("a byte-level vocabulary has a token for each byte")
    return tokens


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer message: bytes with their length, whole numbers as varints, floats in four bytes."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def model_of(tokens: Sequence[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose piece i is tokens[i], byte by byte one character, with -i as its score.

    The best score is merged first, so the lowest rank is. Normalisation is the identity: no prefix, no
    white space removed or escaped, no character map. An unknown piece, which a model must have, comes last; no text has it.
    """
    pieces = [_field(1, t.decode("latin-1").translate(_LETTERS).encode()) + _field(2, float(-i)) + _field(3, 1) for i, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Ids of texts and texts of ids, for one vocabulary and one pattern that cuts texts before merges."""

    def __init__(self, path: str, pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_of(read_ranks(path)))
        self.cut = regex.compile(pattern)
        letters = {c: b for b, c in _LETTERS.items()}
        self.bytes_of = [self.model.id_to_piece(i).translate(letters).encode("latin-1") for i in range(self.model.get_piece_size() - 1)]
        self.known: dict[str, bytes] = {}

    def _learn(self, tokens: set[str]) -> dict[str, bytes]:
        order = list(tokens)
        pieces = [t.encode("utf-8", "surrogatepass").decode("latin-1").translate(_LETTERS) for t in order]
        return {t: array("I", ids).tobytes() for t, ids in zip(order, self.model.encode(pieces, num_threads=1), strict=True)}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers, each match of the pattern by itself."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Sequence[str]) -> Iterator[bytes]:
        """encode() of each text. Texts are cut together, so pre-tokens that nobody has seen go to the model in few calls; long ones come in parts."""
        held: list[str] = []
        size = 0
        for text in texts:
            if held and size + len(text) > PART:
                yield from self._together(held)
                held, size = [], 0
            if len(text) > PART:
                found = (m[0] for m in self.cut.finditer(text))
                yield b"".join(b"".join(self._ids([tokens])[0]) for tokens in iter(lambda: list(islice(found, PART)), []))  # noqa: B023
            else:
                held.append(text)
                size += len(text)
        yield from self._together(held)

    def _together(self, texts: list[str]) -> list[bytes]:
        return [b"".join(ids) for ids in self._ids([self.cut.findall(t) for t in texts])]

    def _ids(self, cut: list[list[str]]) -> list[list[bytes]]:
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*cut)
        known = self.known
        known.update(self._learn(new))
        out = [[known[t] for t in tokens] for tokens in cut]
        for t in new:
            if len(t) > LONGEST:
                del known[t]
        return out

    def decode(self, ids: bytes | memoryview) -> bytes:
        """The bytes that encode() turned into ids. An id that no piece has raises IndexError."""
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One for each worker, which keeps its pre-tokens from task to task."""
    return ByteBpe(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, keep: Sequence[str] | None = None, name: str = "tokens", text: str = "text") -> DataFrame:
    """The columns `keep` of docs (all by default) and `name`, the ids of each row's whole text as little-endian unsigned 32-bit numbers.

    path names a file of ranks that every executor has, pattern what cuts a text before merges. A null or empty
    text has no ids (an empty value, not null). A column called `name` is replaced. Equal rows are each
    encoded; rows keep their partitions, nothing moves. An empty table gives no rows.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    return _mapped(docs, keep, text, "string", name, lambda values: byte_bpe(path, pattern).encode_all([v or "" for v in values]))


def decoded(rows: DataFrame, path: str, pattern: str, keep: Sequence[str] | None = None, name: str = "bytes", tokens: str = "tokens") -> DataFrame:
    """The columns `keep` of rows (all by default) and `name`, the bytes that the ids in `tokens` stand for; null ids give none."""
    keep = [c for c in (rows.columns if keep is None else keep) if c != name]
    return _mapped(rows, keep, tokens, "binary", name, lambda values: (byte_bpe(path, pattern).decode(v or b"") for v in values))


def _mapped(rows: DataFrame, keep: list[str], of: str, kind: str, name: str, run: Callable[[list], Iterable[bytes]]) -> DataFrame:
    """keep and `name`, what run gives for the values of the column `of`, a batch of a few MB (or one long row) at a time."""

    def each(batches: Batches) -> Batches:
        for batch in batches:
            values = pa.array(run(batch.column(batch.num_columns - 1).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], names=[*keep, name])

    schema = StructType([*rows.select(*keep).schema.fields, StructField(name, BinaryType())])
    free = max([*keep, "value"], key=len) + "_"  # longer than any name there is
    return in_python(rows.select(*keep, F.col(of).cast(kind).alias(free)), each, schema)


def round_trips(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document: its text encoded, the ids decoded again, and both hashed."""
    ids = encoded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path, pattern, ["doc_id"])
    back = decoded(ids, path, pattern)
    return back.select("doc_id", F.expr("CAST(octet_length(tokens) DIV 4 AS BIGINT)").alias("n_tokens"), F.sha2("tokens", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
