"""Benchmark decontamination by exact n-gram windows.

Test items become a hash set of word windows, broadcast when its counted size
is within a bound; one scan of the documents marks every word that lies inside
an occurrence of a window.  A larger set is cut into slices by hash, each
within the bound, and the documents pass once per slice.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Masked, text_batches, written

WINDOW = 10
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Byte by byte what UPPER -> LOWER and NON_WORD -> space do to UTF-8.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD_SPAN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Windows that a broadcast set may hold.
MAX_WINDOWS = 250_000
HITS = "n_words long, spans array<struct<first int, last int>>, items array<string>"


def word_array(text: Column) -> Column:
    """Normalised words of a text column; none for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(plain, NON_WORD), lambda w: w != "")


def window_table(items: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(win, length, items)``: each distinct window and the items that hold
    it.  An item of fewer than ``n`` words, but not none, is one window.
    """
    rows = items.select(F.col(id_col).cast("string").alias("item"), word_array(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    rows = rows.withColumn("length", F.least(F.size("w"), F.lit(n)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)
    rows = rows.select("item", "length", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.col("length")), " "))).alias("win"))
    return rows.groupBy("win", "length").agg(F.sort_array(F.collect_set("item")).alias("items"))


class WindowSet:
    """Windows as keys of a dictionary over the ids of their words."""

    def __init__(self, rows) -> None:
        self.vocab: dict[bytes, int] = {}
        self.by_length: dict[int, dict[bytes, list[str]]] = {}
        for win, length, items in rows:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in win.encode().split(b" ")]
            self.by_length.setdefault(length, {})[np.array(ids, np.int32).tobytes()] = items

    def hits(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, maximal hit word spans (inclusive), items hit."""
        words = text.translate(NORMAL).split() if text else []
        if not words:
            return 0, [], set()
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        mask, found = np.zeros(len(words) + 1, np.int8), set()
        for length, wins in self.by_length.items():
            if length > len(words):
                continue
            for s in np.flatnonzero(known[length:] - known[:-length] == length).tolist():
                items = wins.get(ids[s : s + length].tobytes())
                if items is not None:
                    mask[s : s + length] = 1
                    found.update(items)
        if not mask.any():
            return len(words), [], found
        turns = np.flatnonzero(np.diff(np.concatenate(([0], mask))))
        return len(words), [(int(a), int(b) - 1) for a, b in zip(turns[::2], turns[1::2], strict=True)], found


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def with_hits(docs: DataFrame, items: DataFrame, n: int = WINDOW, text_col: str = "text", max_windows: int = MAX_WINDOWS, hits: str = "hits") -> DataFrame:
    """``docs`` with a column (``hits``): ``n_words``, the word ``spans`` inside
    benchmark windows (0-based, inclusive, merged) and the ``items`` they hold.

    Null and empty texts have no words and no hits; no items, no hits.  An
    item with a null id marks its words but is not listed.  A column of the
    name ``hits`` gives that ``docs`` has already is replaced.
    """
    spark = docs.sparkSession
    text_batches(spark)
    windows = window_table(items, n).persist()
    masked = Masked(docs)
    try:
        slices = max(1, -(-windows.count() // max_windows))
        slice_of = F.pmod(F.xxhash64("win"), F.lit(slices))
        out = masked.df
        for k in range(slices):
            held = spark.sparkContext.broadcast(WindowSet([tuple(r) for r in windows.where(slice_of == k).toLocalIterator()]))
            out = _scanned(out, held, masked[text_col], "_hits", first=k == 0)
            if k + 1 < slices:
                out = written(out, "decontam")
                held.unpersist()
    finally:
        windows.unpersist()
    return out.select(*[F.col(m).alias(c) for c, m in masked.names.items() if c != hits], F.col("_hits").alias(hits))


def _scanned(docs: DataFrame, held, text_col: str, hits: str, first: bool) -> DataFrame:
    @F.pandas_udf(HITS)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = [held.value.hits(t) for t in texts]
        return pd.DataFrame({"n_words": [r[0] for r in rows], "spans": [r[1] for r in rows], "items": [sorted(r[2]) for r in rows]})

    @F.pandas_udf(HITS)
    def more(texts: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        rows = [held.value.hits(t) for t in texts]
        spans = [_joined([(s["first"], s["last"]) for s in old] + r[1]) for r, old in zip(rows, before["spans"], strict=True)]
        return pd.DataFrame({"n_words": [r[0] for r in rows], "spans": spans, "items": [sorted(r[2].union(old)) for r, old in zip(rows, before["items"], strict=True)]})

    raw = F.col(text_col).cast("binary")
    return docs.withColumn(hits, scan(raw) if first else more(raw, F.col(hits)))


def digest(hits: str = "hits") -> list[Column]:
    """Per-document counts of a ``hits`` column."""
    h = F.col(hits)
    n_hit = F.aggregate(h["spans"], F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return [
        h["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(h["items"]), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    ]


def decontaminate(docs: DataFrame, items: DataFrame, n: int = WINDOW, remove: str = "documents", text_col: str = "text") -> DataFrame:
    """``docs`` without benchmark passages.

    ``remove="documents"`` drops documents with any hit; ``"spans"`` cuts the
    hit words, and what stands between them, out of the text.  Columns stay as
    they are, whatever their names; documents with a null or empty text stay.
    """
    masked = Masked(docs)
    text = masked[text_col]
    found = with_hits(masked.df, items, n, text, hits="_hits")
    if remove == "documents":
        return found.where(F.size("_hits.spans") == 0).select(*masked.restored())

    @F.pandas_udf("string")
    def without(texts: pd.Series, hits: pd.DataFrame) -> pd.Series:
        return pd.Series([t if not len(s) else _cut_out(t, s) for t, s in zip(texts, hits["spans"], strict=True)], dtype=object)

    cleaned = F.when(F.size("_hits.spans") > 0, without(F.col(text).cast("binary"), "_hits")).otherwise(F.col(text))
    return found.withColumn(text, cleaned).select(*masked.restored())


def _cut_out(text: bytes, spans) -> bytes:
    at = [m.span() for m in WORD_SPAN.finditer(text)]
    out, end = [], 0
    for s in spans:
        out.append(text[end : at[s["first"]][0]])
        end = at[s["last"]][1]
    return (b"".join(out) + text[end:]).decode()


def items_digest(ids) -> str:
    """The digest of a set of item ids as ``digest()`` gives it."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


ORACLE = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
cand AS (
  SELECT rid, l, i, array_to_string(w[i : i + l - 1], ' ') AS win
  FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)),
hit AS (SELECT c.rid, c.l, c.i, win.item_id FROM cand c JOIN win ON c.l = win.l AND c.win = win.win),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS p FROM hit) GROUP BY rid),
its AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
