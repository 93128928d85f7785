"""Approximate nearest neighbours: an inverted file with product quantisation.

Coarse centroids and residual codebooks are fitted on a bounded sample; every
distinct vector is put into the cell of its nearest centroid with the code of
its residual, and with that code's error.  A query visits its nearest cells and
bounds the distance of their vectors by asymmetric tables and those errors; all
that the bounds let pass are reranked by exact distance, so nothing is lost
within a cell.  How many cells are visited is calibrated by brute force of some
queries against all vectors.  Cells are searched in blocks of bounded size, so
a cell with many vectors or many queries becomes several tasks.  Equal vectors
are indexed once: among them only the smallest ids can be among the nearest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, written


@dataclass(frozen=True)
class IvfPlan:
    """``train_rows`` distinct vectors, by hash, fit the centroids and
    codebooks.  There are about sqrt(rows) cells, ``max_cells`` at most; a
    query visits so many that ``recall`` of the neighbours of ``calibration``
    queries lie in them, ``min_probes`` at least.  ``sub`` dimensions share a
    codebook of ``codes`` entries.
    """

    train_rows: int = 20_000
    max_cells: int = 4096
    recall: float = 0.98
    min_probes: int = 8
    calibration: int = 400
    sub: int = 4
    codes: int = 256
    block_rows: int = 4096
    block_queries: int = 2048
    seed: int = 1


def _nearest(x: np.ndarray, c: np.ndarray, chunk: int = 4096) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([(half - x[i : i + chunk] @ c.T).argmin(axis=1) for i in range(0, len(x), chunk)]) if len(x) else np.empty(0, np.int64)


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """Centroids of ``k`` clusters; empty ones restart at a random vector."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].astype(x.dtype)
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c, dtype=np.float64)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)]).astype(x.dtype)
    return c


@dataclass(frozen=True)
class Quantiser:
    """Cell centroids and, per group of dimensions, residual codebooks."""

    centroids: np.ndarray
    groups: list[slice]
    books: list[np.ndarray]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, code and the code's error (a distance) of each vector."""
        cell = _nearest(x, self.centroids)
        rest = x - self.centroids[cell]
        code = np.column_stack([_nearest(rest[:, g], b) for g, b in zip(self.groups, self.books, strict=True)]).astype(np.uint8)
        off = sum(((rest[:, g] - b[c]) ** 2).sum(axis=1) for g, b, c in zip(self.groups, self.books, code.T, strict=True))
        return cell, code, np.sqrt(off)

    def tables(self, q: np.ndarray, cell: int) -> list[np.ndarray]:
        """Squared distance of each query's residual to each codebook entry."""
        rest = q - self.centroids[cell]
        return [((rest[:, None, g] - b[None]) ** 2).sum(axis=2) for g, b in zip(self.groups, self.books, strict=True)]


def fit(sample: np.ndarray, n_cells: int, plan: IvfPlan) -> Quantiser:
    centroids = kmeans(sample, n_cells, seed=plan.seed)
    rest = sample - centroids[_nearest(sample, centroids)]
    groups = [slice(i, min(i + plan.sub, sample.shape[1])) for i in range(0, sample.shape[1], plan.sub)]
    return Quantiser(centroids, groups, [kmeans(rest[:, g], plan.codes, seed=plan.seed + 1 + i) for i, g in enumerate(groups)])


def calibrated_probes(index: DataFrame, asked: np.ndarray, q: Quantiser, ready: Callable[[pd.Series], np.ndarray], k: int, plan: IvfPlan) -> int:
    """How many of their nearest cells hold ``recall`` of the ``k`` nearest
    vectors of some queries (``asked``), by brute force over the whole index.
    """
    rank = np.argsort(np.argsort((q.centroids**2).sum(axis=1) / 2 - asked @ q.centroids.T, axis=1), axis=1)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        far, cell = np.full((len(asked), k), np.inf), np.zeros((len(asked), k), np.int64)
        for pdf in batches:
            for i in range(0, len(pdf), 4096):
                x = ready(pdf["v"].iloc[i : i + 4096])
                d = (x * x).sum(axis=1) - 2 * asked @ x.T + (asked * asked).sum(axis=1)[:, None]
                d[(x[None, :, 0] == asked[:, None, 0]) & (d <= 1e-12 * (1 + (asked * asked).sum(axis=1)[:, None]))] = np.inf  # itself
                far = np.concatenate((far, d), axis=1)
                cell = np.concatenate((cell, np.broadcast_to(pdf["cell"].to_numpy()[i : i + 4096], d.shape)), axis=1)
                best = np.argpartition(far, k - 1, axis=1)[:, :k]
                far, cell = np.take_along_axis(far, best, 1), np.take_along_axis(cell, best, 1)
        yield pd.DataFrame({"q": np.repeat(np.arange(len(asked)), k), "dist": far.ravel(), "cell": cell.ravel()})

    found = index.select("cell", "v").mapInPandas(near, "q int, dist double, cell int").where("dist < double('infinity')")
    first = F.row_number().over(Window.partitionBy("q").orderBy("dist"))
    found = found.withColumn("_n", first).where(F.col("_n") <= k).select("q", "cell").toPandas()  # calibration x k rows
    needed = int(np.quantile(rank[found["q"], found["cell"]], plan.recall)) + 1 if len(found) else 1
    return min(len(q.centroids), max(plan.min_probes, needed))


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pd.Series, d: int, kind: type = np.float32) -> np.ndarray:
    return np.concatenate(column.tolist()).astype(kind).reshape(-1, d) if len(column) else np.empty((0, d), kind)


RESULT = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, plan: IvfPlan | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for every
    row where ``is_query`` (a condition on ``_id``) holds, by Euclidean
    distance on the original vectors, ties to the smaller id.

    Vectors that are null, zero or not finite take no part, nor do rows with a
    null id or a length other than the most frequent one (the smallest, on a
    tie).  Repeated rows of one id and vector count once; a row is no
    neighbour of its own id.  With fewer candidates all are returned; without
    vectors nothing is.  Other columns are not read.
    """
    spark, plan = vectors.sparkSession, plan or IvfPlan()
    rows = vectors.select(quoted(id_col).cast("long").alias("_id"), quoted(vector_col).alias("_v")).where(F.col("_id").isNotNull() & usable(F.col("_v")))
    lengths = rows.groupBy(F.size("_v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], RESULT)
    d = lengths[0][0]
    rows = rows.where(F.size("_v") == d).dropDuplicates(["_id", "_v"])
    first = F.row_number().over(Window.partitionBy("_v").orderBy("_id"))
    classes = rows.withColumn("_rank", first).where(F.col("_rank") <= k + 1).groupBy("_v").agg(F.array_sort(F.collect_list("_id")).alias("ids"))
    classes = written(classes.select(F.col("ids")[0].alias("node"), "ids", "_v"), "ivf-vectors")
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("_v"), "node").limit(plan.train_rows).select("_v").toPandas()["_v"]
    n_cells = max(1, min(plan.max_cells, round(n**0.5)))
    # vectors keep their own precision all the way; only single ones are held as such
    single = classes.schema["_v"].dataType.elementType.simpleString() == "float"
    kind, column = (np.float32, "array<float>") if single else (np.float64, "array<double>")
    classes = classes if single else classes.withColumn("_v", F.col("_v").cast(column))
    rows = rows if single else rows.withColumn("_v", F.col("_v").cast(column))
    sample = _matrix(sample, d, np.float64)
    # around the middle and on one scale, so that squares keep their digits
    middle = np.median(sample, axis=0)
    scale = np.abs(sample - middle).max() or 1.0

    def ready(column: pd.Series) -> np.ndarray:
        return (_matrix(column, d, np.float64) - middle) / scale

    quantiser = fit((sample - middle) / scale, n_cells, plan)
    held = spark.sparkContext.broadcast(quantiser)

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell, code, off = held.value.encode(ready(pdf["_v"]))
            yield pd.DataFrame({"cell": cell, "node": pdf["node"], "code": [c.tobytes() for c in code], "off": off, "v": pdf["_v"]})

    index = written(classes.mapInPandas(encoded, f"cell int, node long, code binary, off double, v {column}"), "ivf-index")
    asked = rows.where(is_query).select("_id", "_v")
    distinct = asked.groupBy("_v").agg(F.min("_id").alias("query"))
    some = distinct.orderBy(F.xxhash64("query"), "query").limit(plan.calibration).select("_v").toPandas()["_v"]
    probes = calibrated_probes(index, ready(some), quantiser, ready, k, plan)
    filled = {r["cell"]: r["n"] for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
    filled = np.array([filled.get(c, 0) for c in range(len(quantiser.centroids))])

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = held.value.centroids
        half = (c * c).sum(axis=1) / 2
        for pdf in batches:
            for i in range(0, len(pdf), 1024):
                part = pdf.iloc[i : i + 1024]
                near = np.argsort(half - ready(part["_v"]) @ c.T, axis=1)
                # more cells where these hold too few vectors
                enough = np.maximum(probes, (filled[near].cumsum(axis=1) < k + 1).sum(axis=1) + 1)
                visited = np.arange(near.shape[1]) < enough[:, None]
                row = np.nonzero(visited)[0]
                yield pd.DataFrame({"cell": near[visited], "query": part["query"].to_numpy()[row], "v": part["_v"].to_numpy()[row]})

    queries = written(distinct.select("query", "_v").mapInPandas(routed, f"cell int, query long, v {column}"), "ivf-queries")

    # at most max_cells rows each, one per cell
    sizes = index.groupBy("cell").agg(F.ceil(F.count("*") / plan.block_rows).cast("int").alias("bi")).join(queries.groupBy("cell").agg(F.ceil(F.count("*") / plan.block_queries).cast("int").alias("bj")), "cell")
    sizes = F.broadcast(sizes)
    number = lambda col, of: F.pmod(F.xxhash64(col), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = index.join(sizes, "cell").select("cell", number("node", "bi").alias("i"), every("bj").alias("j"), "node", "code", "off", "v")
    right = queries.join(sizes, "cell").select("cell", every("bi").alias("i"), number("query", "bj").alias("j"), "query", "v")

    def searched(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(asked):
            return pd.DataFrame({"query": [], "node": [], "dist": []})
        # distances and errors on the scale of the index, then true ones
        x, node, off = ready(block["v"]), block["node"].to_numpy(), block["off"].to_numpy()
        own, theirs = _matrix(block["v"], d, kind), _matrix(asked["v"], d, kind)
        code = np.frombuffer(b"".join(block["code"]), np.uint8).reshape(len(x), -1)
        q, norms, m, out = ready(asked["v"]), (x * x).sum(axis=1), min(k + 1, len(x)), []
        for s in range(0, len(q), 256):
            part = q[s : s + 256]
            size = (part * part).sum(axis=1)[:, None]
            approx = np.zeros((len(part), len(x)))
            for t, c in zip(held.value.tables(part, int(block["cell"].iloc[0])), code.T, strict=True):
                approx += t[:, c]
            approx = np.sqrt(approx)
            most = np.partition(approx + off, m - 1, axis=1)[:, m - 1 : m]
            passed = approx - off <= most * (1 + 1e-9) + 1e-9 * np.sqrt(norms + size)
            some = np.flatnonzero(passed.any(axis=0))
            far = np.where(passed[:, some], norms[some] + size - 2 * part @ x[some].T, np.inf)
            spare = 1e-12 * (norms[some] + size)
            row, at = np.nonzero(far - spare <= np.partition(far + spare, m - 1, axis=1)[:, m - 1 : m])
            at = some[at]
            dist = np.concatenate([np.sqrt(((own[at[i : i + 65536]].astype(np.float64) - theirs[s + row[i : i + 65536]].astype(np.float64)) ** 2).sum(axis=1)) for i in range(0, len(at), 65536)])
            order = np.lexsort((node[at], dist, row))
            row, at, dist = row[order], at[order], dist[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k + 1
            out.append(pd.DataFrame({"query": asked["query"].to_numpy()[s + row[best]], "node": node[at[best]], "dist": dist[best]}))
        return pd.concat(out)

    keys = ("cell", "i", "j")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(searched, "query long, node long, dist double")
    best = lambda *by: F.row_number().over(Window.partitionBy("query").orderBy(*by))
    found = found.withColumn("_n", best("dist", "node")).where(F.col("_n") <= k + 1)
    found = found.join(classes.select("node", "ids"), "node").select("query", "dist", F.explode("ids").alias("vec_id"))
    found = found.withColumn("_n", best("dist", "vec_id")).where(F.col("_n") <= k + 1)
    found = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("dist", "vec_id"))).alias("near"))
    who = asked.groupBy("_v").agg(F.min("_id").alias("query"))
    answers = asked.join(found.join(who, "query").select("_v", "near"), "_v").withColumnRenamed("_id", "query_id")
    near = F.slice(F.filter("near", lambda s: s["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(near)).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col")["vec_id"].alias("vec_id"), F.col("col")["dist"].alias("score"))


def recall(found: pd.DataFrame, exact: pd.DataFrame) -> float:
    """Share of the exact ``(query_id, vec_id)`` pairs that were found."""
    keys = ["query_id", "vec_id"]
    return len(found[keys].merge(exact[keys])) / max(1, len(exact))
