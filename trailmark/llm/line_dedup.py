"""Cross-site boilerplate: lines that many distinct sites carry.

A HyperLogLog sketch of sites is kept per line hash and merged by aggregation,
so a line costs the same whether three or three million rows have it.  Lines
whose estimate lies near the threshold get an exact distinct count.  What
spreads over enough sites is removed from every document, in one scan with a
broadcast set of hashes of checked size, or several over slices of it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Masked, cut, quoted, text_batches, written

#: A line on this many sites is boilerplate.
MIN_SITES = 5
#: Relative width around the threshold within which the sketch isn't trusted;
#: over four standard errors of a sketch of 2**LG_K registers.
NEAR = 0.3
LG_K = 8
#: Line hashes that one broadcast may hold (8 bytes each).
MAX_SET = 4_000_000


def line_hashes(docs: DataFrame, site_col: str, text_col: str) -> DataFrame:
    """``(h, site)`` of every line that isn't blank; spaces around it are
    ignored.
    """
    lines = docs.select(quoted(site_col).cast("string").alias("site"), F.explode(F.split(quoted(text_col), "\n")).alias("line"))
    return lines.select(F.xxhash64(F.trim("line")).alias("h"), "site", F.trim("line").alias("line")).where("line <> ''").drop("line")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(h, sites)``: hashes of lines on ``min_sites`` distinct sites or more.
    A null site is none.  ``sites`` is exact near the threshold, else estimated.
    """
    lines = line_hashes(docs, site_col, text_col)
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"))
    spread = cut(spread.where(F.col("sites") >= min_sites * (1 - NEAR)))
    sure = spread.where(F.col("sites") > min_sites * (1 + NEAR))
    near = spread.where(F.col("sites") <= min_sites * (1 + NEAR)).select("h")
    if near.count() <= MAX_SET // 4:
        near = F.broadcast(near)
    exact = lines.join(near, "h").distinct().groupBy("h").agg(F.count("site").alias("sites"))
    return cut(sure.unionByName(exact.where(F.col("sites") >= min_sites)))


def _cleaner(held):
    """A UDF that cuts lines of the broadcast hashes out of texts."""

    @F.pandas_udf("text string, n long")
    def cleaned(texts: pd.Series) -> pd.DataFrame:
        known, new, n = held.value, [], []
        for text in texts:
            lines = text.split(b"\n") if text is not None and len(known) else []
            keys = [x.strip(b" ") for x in lines]
            h = np.array([xxhash.xxh64_intdigest(x, 42) for x in keys], np.uint64).view(np.int64)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            gone = [bool(x) and k for x, k in zip(keys, (known[at] == h).tolist(), strict=True)] if lines else []
            new.append(b"\n".join(x for x, g in zip(lines, gone, strict=True) if not g).decode() if any(gone) else None)
            n.append(sum(gone))
        return pd.DataFrame({"text": pd.Series(new, dtype=object), "n": n})

    return cleaned


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source", text_col: str = "text", max_set: int = MAX_SET, removed: str = "removed_lines") -> DataFrame:
    """``docs`` with boilerplate lines cut out of the text and a column
    (``removed``, replaced if it is there) with how many.

    Other lines stay as they are, in order, blank ones too.  A null text stays
    null and has none removed; a text of nothing else becomes empty.
    """
    spark = docs.sparkSession
    found = boilerplate(docs, min_sites, site_col, text_col).select("h")
    slices = max(1, -(-found.count() // max_set))
    text_batches(spark)
    masked = Masked(docs)
    text = masked[text_col]
    out = masked.df.withColumn("_removed", F.lit(0).cast("long"))
    for k in range(slices):
        hashes = np.array([r[0] for r in found.where(F.pmod("h", F.lit(slices)) == k).toLocalIterator()], np.int64)
        held = spark.sparkContext.broadcast(np.sort(hashes))
        out = out.withColumn("_step", _cleaner(held)(F.col(text).cast("binary")))
        out = out.withColumns({text: F.when(F.col("_step.n") > 0, F.col("_step.text")).otherwise(F.col(text)), "_removed": F.col("_removed") + F.col("_step.n")}).drop("_step")
        if k + 1 < slices:
            out = written(out, "line-dedup")
    return out.select(*[F.col(n).alias(c) for c, n in masked.names.items() if c != removed], F.col("_removed").alias(removed))


#: The query over ``documents`` with the default threshold, by DuckDB.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL),
b AS (SELECT trim(line) AS line FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 5),
k AS (
  SELECT rid, count(*) AS n_lines, count(b.line) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE b.line IS NULL), '') AS rest
  FROM l LEFT JOIN b ON trim(l.line) = b.line GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(rest) AS text_sha256
FROM d LEFT JOIN k USING (rid)
"""
