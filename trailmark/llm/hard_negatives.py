"""Hard negatives: rows of another label that score close below a positive.

Every anchor is scored against every row in whole numbers.  Rows are dealt into
blocks of bounded size, and each block of rows meets each group of anchors in
one task: first for the anchors' positives, then, with the positives' scores
known, for what lies between the limits.  In the second pass a block is sorted
by score and id for each anchor, a binary search finds each positive's upper
limit, and the next rows of other labels are read down to the lower one.  The
first k of all rows are among the first k of the blocks, so the merge is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, written

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int"


@dataclass(frozen=True)
class MiningPlan:
    """Each anchor has ``positives``, each with ``negatives`` whose score is
    from ``low`` to ``high`` hundredths of its own.  Components are multiplied
    by ``scale`` and rounded down.  A block has about ``block_rows`` rows and
    meets ``group_anchors`` anchors, of which ``at_once`` are scored together.
    """

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256
    block_rows: int = 16_384
    group_anchors: int = 1_024
    at_once: int = 64

    def __post_init__(self) -> None:
        if min(self.positives, self.negatives, self.scale, self.block_rows, self.group_anchors, self.at_once) < 1:
            raise ValueError("counts and sizes must be 1 or more")


def whole_numbers(column: pd.Series, d: int, scale: int) -> np.ndarray:
    """Components times ``scale``, rounded down, as doubles that are whole."""
    x = np.concatenate(column.tolist()).astype(np.float64) if len(column) and d else np.empty(0)
    return np.floor(x.reshape(len(column), d) * scale)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as longs.

    Products of doubles are exact below 2^53, of longs below 2^63; what may be
    larger goes through unbounded integers and is held to the range of a long.
    """
    most = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * anchors.shape[1]
    if most < 2**53:
        return (anchors @ rows.T).astype(np.int64)
    if most < 2**62:
        return anchors.astype(np.int64) @ rows.astype(np.int64).T
    exact = lambda m: np.array([[int(v) for v in r] for r in m], dtype=object).reshape(m.shape)
    return np.clip(exact(anchors) @ exact(rows).T, 1 - 2**63, 2**63 - 1).astype(np.int64)


def limits(score: np.ndarray, plan: MiningPlan) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of a negative: ``low * p <= 100 * n <= high * p``."""
    whole, rest = score // 100, score % 100
    return whole * plan.low + -((-rest * plan.low) // 100), whole * plan.high + rest * plan.high // 100


def usable(vector: Column, scale: int) -> Column:
    """Not null, and each component finite, also when multiplied."""
    return F.coalesce(F.forall(vector, lambda v: F.coalesce(F.abs(v.cast("double") * scale) < float("inf"), F.lit(False))), F.lit(False))


def mine(rows: DataFrame, is_anchor: Column, plan: MiningPlan | None = None, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """``RESULT``: for each positive of each row where ``is_anchor`` (a
    condition on ``_id``) holds, its hard negatives from the best score down.

    An anchor's positives are its best other rows of the same label; ties go
    to the smaller id everywhere.  Rows with a null id, label or vector, or a
    null or non-finite component, take no part, nor do those of another length
    than the most frequent one (the smallest, on a tie).  Repeated rows count
    once.  A row is neither a positive nor a negative of its own id; of
    different rows of one id the least by label and vector is the anchor, all
    may be found.  An anchor without a positive, or a positive without a row
    between the limits, gives no row, as does an empty frame.  Scores beyond a
    long are held to its range.  Labels may have any type that compares; other
    columns are not read.
    """
    spark, plan = rows.sparkSession, plan or MiningPlan()
    kept = rows.select(quoted(id_col).cast("long").alias("_id"), quoted(label_col).cast("string").alias("_label"), quoted(vector_col).alias("_v"))
    kept = kept.where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & usable(F.col("_v"), plan.scale)).withColumn("_d", F.size("_v"))
    lengths = kept.groupBy("_d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], RESULT)
    d, n = lengths[0]
    rows = written(kept.where(F.col("_d") == d).drop("_d").distinct(), "mining-rows")
    n_blocks, scale = max(1, -(-n // plan.block_rows)), plan.scale
    anchors = rows.where(is_anchor).groupBy("_id").agg(F.min(F.struct("_label", "_v")).alias("a"))
    anchors = written(anchors.select(F.col("_id").alias("_anchor"), "a._label", "a._v"), "mining-anchors")
    n_groups = max(1, -(-anchors.count() // plan.group_anchors))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    blocks = rows.withColumn("_block", F.pmod(F.xxhash64("_id", "_label", "_v"), F.lit(n_blocks)).cast("int")).withColumn("_group", every(n_groups))
    blocks = blocks.groupBy("_block", "_group")

    def asked(of: DataFrame):
        group = F.pmod(F.xxhash64("_anchor"), F.lit(n_groups)).cast("int")
        return of.withColumn("_group", group).withColumn("_block", every(n_blocks)).groupBy("_block", "_group")

    def parts(block: pd.DataFrame, some: pd.DataFrame):
        """Few anchors at a time with their scores of the block's rows."""
        x, q = whole_numbers(block["_v"], d, scale), whole_numbers(some["_v"], d, scale)
        ids, labels = block["_id"].to_numpy(np.int64), block["_label"].to_numpy(object)
        codes, known = pd.factorize(labels)
        place = {v: i for i, v in enumerate(known)}
        own = [place.get(v, -1) for v in some["_label"]]
        for s in range(0, len(some), plan.at_once):
            found = scores(q[s : s + plan.at_once], x)
            for i, row in enumerate(found, s):
                yield i, row, ids, codes == own[i]

    def best_same(block: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        out, names = [], some["_anchor"].to_numpy(np.int64)
        for i, score, ids, same in parts(block, some) if len(block) and len(some) else ():
            at = np.flatnonzero(same & (ids != names[i]))
            at = at[np.lexsort((ids[at], -score[at]))][: plan.positives]
            out += zip([names[i]] * len(at), ids[at].tolist(), score[at].tolist(), strict=True)
        return pd.DataFrame(out, columns=["_anchor", "id", "score"])

    def between(block: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        out, names = [], some["_anchor"].to_numpy(np.int64)
        for i, score, ids, same in parts(block, some) if len(block) and len(some) else ():
            order = np.lexsort((ids, -score))
            order = order[~same[order] & (ids[order] != names[i])]
            ranked, wanted = score[order], some["positives"].iloc[i]
            low, high = limits(np.array([p["score"] for p in wanted], np.int64), plan)
            first = np.searchsorted(-ranked, -high, side="left")
            last = np.minimum(np.searchsorted(-ranked, -low, side="right"), first + plan.negatives)
            for nth, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
                at = order[a:b]
                out += zip([names[i]] * len(at), [nth] * len(at), ids[at].tolist(), score[at].tolist(), strict=True)
        return pd.DataFrame(out, columns=["_anchor", "nth", "id", "score"])

    def first(of: DataFrame, k: int, *by: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
        return of.withColumn("rank", rank).where(F.col("rank") <= k)

    same = blocks.cogroup(asked(anchors)).applyInPandas(best_same, "_anchor long, id long, score long")
    same = first(same, plan.positives, "_anchor")
    chosen = same.groupBy("_anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))), lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score"))).alias("positives"))
    chosen = written(anchors.join(chosen, "_anchor"), "mining-positives")
    found = blocks.cogroup(asked(chosen)).applyInPandas(between, "_anchor long, nth int, id long, score long")
    found = first(found, plan.negatives, "_anchor", "nth")
    named = found.join(chosen.select("_anchor", "positives"), "_anchor").withColumn("p", F.get("positives", F.col("nth")))
    return named.select(
        F.col("_anchor").alias("anchor_id"), F.col("p.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"), (F.col("nth") + 1).alias("positive_rank"),
    )


# fixed values: the rules of the default plan, as SQL
ORACLE = """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS id, b.label, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), p AS (
  SELECT anchor_id, anchor_label, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS positive_rank
  FROM s WHERE label = anchor_label QUALIFY positive_rank <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_rank ORDER BY s.score DESC, s.id))::INTEGER AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score, p.positive_rank::INTEGER AS positive_rank
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
