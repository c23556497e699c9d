"""Byte-level BPE against the tiktoken library, and exact round trips."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nocturne.llm import byte_bpe, queries
from nocturne.llm.common import table

SF = "/root/testdata/sf0.001"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(tokens):
    return np.frombuffer(tokens, "<u4").tolist()


def test_every_token_and_code_point_encodes_alike(theirs):
    own = byte_bpe.byte_bpe(PATH, PATTERN)
    assert own.bytes_of == byte_bpe.read_ranks(PATH)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 50_000):
        text = "".join(f"a{c}1{c}! {c}{c}  x" for c in points[at : at + 50_000 : 7])
        assert ids_of(own.encode(text)) == theirs.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
def test_any_text_encodes_alike_and_comes_back(theirs, text):
    own = byte_bpe.byte_bpe(PATH, PATTERN)
    assert ids_of(own.encode(text)) == theirs.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


def test_long_texts_come_in_parts_and_few_words_are_remembered(theirs, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PART", 50)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 20)
    own = byte_bpe.ByteBpe(PATH, PATTERN)
    texts = ["", " ".join(f"w{i}é" for i in range(400)), "a", "", "x" * 3000, " " * 777, "'s it's", "short one"]
    assert [ids_of(x) for x in own.encode_all(texts)] == [theirs.encode_ordinary(t) for t in texts]


def test_query_against_the_library(spark, theirs):
    rows = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    got = queries.op12_byte_bpe(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = theirs.encode_ordinary(rows[r["doc_id"]])
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest())
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want


def test_odd_rows_other_columns_and_empty_tables(spark, theirs):
    rows = [(1, None, None), (None, "no id", "t"), (2, "", None), (3, " \n\t ", "t"), (3, " \n\t ", "t"), (4, "Straße É中文 \U0001f600 <unk> <|endoftext|> end", "t"), (5, "\x00\x1c▁", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string").withColumns({"bytes": F.lit(7), "_nocturne_of": F.lit("x"), "n_tokens": F.lit("y")})
    got = byte_bpe.round_trips(docs, PATH, PATTERN).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["decoded_sha256"]) for r in got) == sorted((i or 0, len(theirs.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert all(r["ids_sha256"] == empty for r in got if r["doc_id"] in (1, 2))
    whole = byte_bpe.decoded(byte_bpe.encoded(docs, PATH, PATTERN), PATH, PATTERN)
    assert set(whole.columns) == set(docs.columns)
    assert {(r["doc_id"], bytes(r["bytes"]).decode()) for r in whole.collect()} == {(i, t or "") for i, t, _ in rows}
    assert byte_bpe.round_trips(docs.limit(0), PATH, PATTERN).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, tokens binary")
    assert bytes(byte_bpe.decoded(nulls, PATH, PATTERN).first()["bytes"]) == b""


def test_a_vocabulary_without_every_byte_is_refused(tmp_path):
    (tmp_path / "ranks").write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="each byte"):
        byte_bpe.read_ranks(tmp_path / "ranks")
