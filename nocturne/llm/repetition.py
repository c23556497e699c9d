"""Quality rules by repetition coverage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_python
from .textarrays import CHAR_INVERSE, WORD_BASE, WORD_INVERSE, Words, mix, rolling, slices, text_pieces

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_chars long, dup_5gram_chars long, dup_7gram_chars long, dup_10gram_chars long, base_failed boolean, kept boolean"
)
#: Largest percentage of a text's word characters inside repeated n-grams of n words, by n.
NGRAM_LIMITS = {5: 15, 7: 13, 10: 10}
#: Largest percentage inside repeated lines.
LINE_LIMIT = 30


def _repeats(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal one in their text, and which an equal one before them."""
    key = mix(key + mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, shared = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    shared[order[1:]] = same
    shared[order[:-1]] |= same
    return shared, later


def _ngrams(w: Words, prefix: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each run of n words within a text."""
    i = np.arange(max(0, len(w.doc) - n + 1))
    i = i[w.doc[i] == w.doc[i + n - 1]]
    return i, slices(prefix, i, i + n, WORD_INVERSE)


def _covered(first: np.ndarray, n: int, total: int) -> np.ndarray:
    step = np.bincount(first, minlength=total + 1)[: total + 1] - np.bincount(first + n, minlength=total + 1)[: total + 1]
    return np.cumsum(step)[:total] > 0


def measure(texts: list) -> dict[str, np.ndarray]:
    """The counts of SCHEMA for some texts."""
    w = Words(texts)
    chars = (w.end - w.start).astype(np.int64)
    per_doc = lambda doc, weight=None: np.bincount(doc, weight, minlength=w.n).astype(np.int64)
    out = {"n_words": per_doc(w.doc), "word_chars": per_doc(w.doc, chars)}
    symbols = np.flatnonzero(np.isin(w.codes, np.array([ord(c) for c in "#*$%&|<>"], np.uint32)))
    out["n_symbols"] = per_doc(np.searchsorted(w.bounds, symbols, side="right") - 1)

    start, end, doc = w.lines()
    words_before = np.concatenate([[0], np.cumsum(w.word)])
    filled = words_before[end] > words_before[start]
    start, end, doc = start[filled], end[filled], doc[filled]
    key = slices(w.prefix, start, end, CHAR_INVERSE) + (end - start).astype(np.uint64)
    _, later = _repeats(key, doc)
    out["n_dup_lines"] = per_doc(doc[later])
    out["dup_line_chars"] = per_doc(doc[later], (words_before[end] - words_before[start])[later])

    prefix = rolling(w.key, WORD_BASE)
    i, key = _ngrams(w, prefix, 3)
    shared, _ = _repeats(key, w.doc[i])
    out["n_repeat_words"] = per_doc(w.doc[_covered(i[shared], 3, len(w.doc))])
    for n in NGRAM_LIMITS:
        i, key = _ngrams(w, prefix, n)
        _, later = _repeats(key, w.doc[i])
        inside = _covered(i[later], n, len(w.doc))
        out[f"dup_{n}gram_chars"] = per_doc(w.doc[inside], chars[inside])

    out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    kept = ~out["base_failed"] & (100 * out["dup_line_chars"] <= LINE_LIMIT * out["word_chars"])
    for n, limit in NGRAM_LIMITS.items():
        kept &= 100 * out[f"dup_{n}gram_chars"] <= limit * out["word_chars"]
    return out | {"kept": kept}


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        ids = batch.column(0)
        for a, b, texts in text_pieces(batch.column(1)):
            found = measure(texts)
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *(pa.array(found[x]) for x in names[1:])], names=names)


def repetition_rules(docs: DataFrame) -> DataFrame:
    """One row per document: word, symbol and repetition counts, and the verdict `kept`.

    Rolling hashes over words find n-grams of 5, 7 and 10 words (and lines) that stood
    earlier in the same text; the characters inside them, the first copy not counted,
    are held against NGRAM_LIMITS and LINE_LIMIT. Texts under 50 words, or with over
    half their words in repeated 3-word windows, fail before that.

    A null or empty text has no words, so it fails and isn't kept. Equal rows give
    equal results; an empty table gives none; columns other than doc_id and text are
    ignored. The work is row by row: no shuffle, and one text is held whole at a time.
    """
    return in_python(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), _batches, SCHEMA)


def _sql() -> str:
    grams = "\n  UNION ALL ".join(
        f"SELECT doc_id, i, {n} AS n, list_aggregate(list_slice(words, i, i + {n - 1}), 'string_agg', ' ') AS gram FROM each_word WHERE i + {n - 1} <= len(words)"
        for n in (3, *NGRAM_LIMITS)
    )
    parts = ", ".join(f"CAST(coalesce(dup_{n}, 0) AS BIGINT) AS dup_{n}gram_chars" for n in NGRAM_LIMITS)
    sums = ", ".join(f"sum(chars) FILTER (WHERE n = {n}) AS dup_{n}" for n in NGRAM_LIMITS)
    limits = " AND ".join(f"100 * dup_{n}gram_chars <= {limit} * word_chars" for n, limit in NGRAM_LIMITS.items())
    names = ", ".join(f"dup_{n}gram_chars" for n in NGRAM_LIMITS)
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
each_word AS (SELECT doc_id, words, CAST(unnest(range(1, len(words) + 1)) AS BIGINT) AS i FROM docs),
grams AS ({grams}),
marked AS (
  SELECT doc_id, i, n, count(*) OVER (PARTITION BY doc_id, n, gram) AS times,
         row_number() OVER (PARTITION BY doc_id, n, gram ORDER BY i) AS nth FROM grams),
inside AS (
  SELECT DISTINCT doc_id, n, i + d AS i FROM marked, (SELECT unnest(range(0, 10)) AS d)
  WHERE d < n AND CASE WHEN n = 3 THEN times > 1 ELSE nth > 1 END),
covered AS (
  SELECT c.doc_id, count(*) FILTER (WHERE n = 3) AS n_repeat, {sums}
  FROM (SELECT x.doc_id, x.n, length(list_extract(d.words, x.i)) AS chars FROM inside x JOIN docs d ON x.doc_id = d.doc_id) c GROUP BY c.doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM docs),
later AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS nth FROM lines
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup_lines AS (
  SELECT doc_id, count(*) AS n_dup, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) AS chars FROM later WHERE nth > 1 GROUP BY doc_id),
base AS (
  SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(d.text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n_repeat, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(l.chars, 0) AS BIGINT) AS dup_line_chars, {parts}
  FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN dup_lines l USING (doc_id)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, {names}, base_failed,
       NOT base_failed AND 100 * dup_line_chars <= {LINE_LIMIT} * word_chars AND {limits} AS kept
FROM failed
"""


#: The same counts and verdict in plain SQL.
SQL = _sql()
