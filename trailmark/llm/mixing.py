"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1.  Each source has a piecewise linear weight
schedule; its integral is the source's overall weight, which fixes how many
words it is asked for, and the running integral is its cumulative demand.  A
source's documents stand in a fixed random order; the word offset of each one
is looked up in the inverse of that demand, which gives the moment at which
training reads it, and a range sort by that moment lays out the mix.

All of it is DataFrame work.  Offsets are sums over (source, hash bucket)
groups of bounded size plus a running sum within each, so a source that holds
a third of all rows is spread like any other.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Masked, cut, quoted, written

#: Documents to a hash bucket, on average.
BUCKET_DOCS = 512
#: Sources whose table is broadcast; more are joined.
BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class Schedule:
    """Weight over training time, linear between the knots ``(time, weight)``;
    times run from 0 to 1 and don't fall, weights are not negative.  Two knots
    at one time make a step.  A source whose weight is 0 all the time is never
    read.
    """

    knots: tuple[tuple[float, float], ...]

    def __post_init__(self) -> None:
        times = [t for t, _ in self.knots]
        if len(times) < 2 or times[0] != 0 or times[-1] != 1 or times != sorted(times) or any(w < 0 for _, w in self.knots):
            raise ValueError("knots must run from time 0 to 1 without falling back, with weights of 0 or more")

    def segments(self) -> list[tuple[float, float, float, float]]:
        """(start, weight there, slope, integral before) of each piece."""
        out, area = [], 0.0
        for (t0, w0), (t1, w1) in zip(self.knots, self.knots[1:], strict=False):
            if t1 == t0:
                continue
            out.append((t0, w0, (w1 - w0) / (t1 - t0), area))
            area += (w0 + w1) / 2 * (t1 - t0)
        return out

    def integral(self) -> float:
        return sum((w0 + w1) / 2 * (t1 - t0) for (t0, w0), (t1, w1) in zip(self.knots, self.knots[1:], strict=False))


@dataclass(frozen=True)
class Curriculum:
    """``schedules`` go to the sources in code point order (null last), again
    and again; the mix asks for ``budget`` times all words; no source is read
    more than ``max_repeat`` times.
    """

    schedules: tuple[Schedule, ...]
    budget: float = 1.5
    max_repeat: int = 2


#: Integrals 5, 2 and 1: the first kind fades, the last one grows.
DEFAULT = Curriculum((Schedule(((0.0, 7.0), (1.0, 3.0))), Schedule(((0.0, 2.0), (1.0, 2.0))), Schedule(((0.0, 0.25), (0.5, 0.75), (1.0, 2.25)))))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, plan: Curriculum) -> DataFrame:
    """One row per source of ``sized (_source, _size)``: its number, ``kind`` of schedule,
    ``source_size``, ``docs`` and ``target``.

    Shares go by weight; a source stops at ``max_repeat`` times its size and
    the excess is shared again.  Sorted by cap over weight the stopped sources
    come first, so running sums find the level of the rest at once.  The
    table has a row per source, and only that is ordered in one place.
    """
    weights = F.array(*[F.lit(float(s.integral())) for s in plan.schedules])
    per = sized.groupBy(F.col("_source")).agg(F.sum("_size").alias("source_size"), F.count("*").alias("docs"))
    per = per.withColumn("_number", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1)
    per = per.withColumn("kind", F.col("_number") % len(plan.schedules))
    per = per.withColumn("weight", F.element_at(weights, F.col("kind") + 1)).withColumn("cap", F.col("source_size") * plan.max_repeat)
    # a source of no weight comes last, stops nowhere and gets nothing
    per = per.withColumn("fill", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
    order = Window.orderBy("fill", F.col("_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    total = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(total) * F.lit(plan.budget) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    per = per.withColumn("level", F.try_divide(left, F.sum("weight").over(after)))
    per = per.withColumn("stops", F.coalesce(F.col("fill") < F.col("level"), F.lit(False)))
    level = F.max(F.when(~F.col("stops"), F.col("level"))).over(total)
    target = F.when(F.col("stops"), F.col("cap").cast("double")).when(F.col("weight") > 0, F.col("weight") * level).otherwise(F.lit(0.0))
    return per.select("_source", "_number", "kind", "source_size", "docs", target.alias("target"))


def moment(kind: Column, share: Column, plan: Curriculum) -> Column:
    """When a source of this kind has had ``share`` of its demand: the inverse
    of the running integral, solved on the linear piece that holds it.
    """

    def solved(s: Schedule) -> Column:
        area = share * F.lit(float(s.integral()))

        def on(t0: float, w0: float, slope: float, done: float) -> Column:
            rest = F.greatest(area - F.lit(done), F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
            return F.lit(t0) + F.when(rest > 0, 2 * rest / F.greatest(F.lit(w0) + root, F.lit(1e-12))).otherwise(0.0)

        pieces = s.segments()
        return reduce(lambda out, p: F.when(area >= F.lit(p[3]), on(*p)).otherwise(out), pieces[1:], on(*pieces[0]))

    return reduce(lambda out, k: F.when(kind == k, solved(plan.schedules[k])).otherwise(out), range(1, len(plan.schedules)), solved(plan.schedules[0]))


OWN = ["_size", "_source_size", "_target", "_offset", "_kind", "_source_number", "_taken"]


def placed(docs: DataFrame, plan: Curriculum = DEFAULT, id_col: str = "doc_id", source_col: str = "source", text_col: str | None = "text", size_col: str | None = None) -> DataFrame:
    """``docs`` with the columns ``OWN``: the words of the document, of its
    source, and of the source's target; the words of the source before it; its
    schedule and source by number; and the words that the mix takes of it,
    repeats counted.  Each source's taken words sum to its target, rounded
    down; the document at the end of it may be taken in part.

    Documents of a source are ordered by the MD5 of their id (of size and
    text where it is null), id and size, so that reruns agree.  Null and empty
    texts have size 0 and are never taken.  Repeated rows each count.  Columns
    named as in ``OWN`` are replaced.
    """
    masked = Masked(docs)
    size = F.col(masked[size_col]).cast("long") if size_col else n_words(F.col(masked[text_col]))
    rows = masked.df.withColumns({"_size": size, "_source": F.col(masked[source_col])})
    out = _placed(rows, plan, masked[id_col], masked.names.get(text_col))
    return out.select(*[F.col(n).alias(c) for c, n in masked.names.items() if c not in OWN], *OWN)


def _placed(rows: DataFrame, plan: Curriculum, id_col: str, text_col: str | None) -> DataFrame:
    """``placed`` for rows with ``_size`` and ``_source`` already."""
    nameless = F.concat_ws(" ", F.lit("size"), F.col("_size").cast("string"), *([F.hex(F.xxhash64(text_col))] if text_col else []))
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), nameless).cast("binary"))
    rows = rows.withColumn("_order", digest)
    narrow = cut(rows.select("_size", "_source", F.substring("_order", 1, 8).alias("_order")))
    targets = cut(source_targets(narrow, plan).withColumnRenamed("_source", "_of"))
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)

    def bucketed(df: DataFrame) -> DataFrame:
        """With the source's number and facts, and the hash bucket."""
        at = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * F.ceil(F.col("docs") / BUCKET_DOCS) / F.lit(2**32)
        return df.join(targets, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of", "_source").withColumn("_bucket", at.cast("long"))

    sums = bucketed(narrow).groupBy("_number", "_bucket").agg(F.sum("_size").alias("_sum"))
    running = Window.partitionBy("_number").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_number", "_bucket", F.coalesce(F.sum("_sum").over(running), F.lit(0)).alias("_before"))
    # the join and the window deal rows out alike, so wide rows move once
    rows = bucketed(rows).join(sums, ["_number", "_bucket"])
    inner = Window.partitionBy("_number", "_bucket").orderBy("_order", F.col(id_col), "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_offset", F.col("_before") + F.coalesce(F.sum("_size").over(inner), F.lit(0)))
    most = F.floor("target").cast("long")
    taken = reduce(lambda a, b: a + b, (F.least(F.col("_size"), F.greatest(most - F.col("source_size") * p - F.col("_offset"), F.lit(0))) for p in range(plan.max_repeat)))
    return rows.withColumns({"_source_size": F.col("source_size"), "_target": F.col("target"), "_kind": F.col("kind"), "_source_number": F.col("_number"), "_taken": taken})


def passes(plan: Curriculum = DEFAULT) -> Column:
    """Of rows of ``placed``: ``array<struct<pass, moment>>`` of the passes in
    which the document is read, and when.

    Documents are whole here: one is read in a pass if its middle word lies
    within the target.  Documents without words are not read.
    """
    middle = F.transform(F.sequence(F.lit(0), F.lit(plan.max_repeat - 1)), lambda p: F.struct(p.alias("pass"), (p * F.col("_source_size") + F.col("_offset") + F.col("_size") / 2).alias("middle")))
    read = F.filter(middle, lambda m: (m["middle"] <= F.col("_target")) & (F.col("_size") > 0))
    return F.transform(read, lambda m: F.struct(m["pass"].alias("pass"), moment(F.col("_kind"), m["middle"] / F.col("_target"), plan).alias("moment")))


def readings(rows: DataFrame, plan: Curriculum = DEFAULT) -> DataFrame:
    """Rows of ``placed`` with one for each time that a document is read:
    ``_pass`` from 0 and ``_moment``.
    """
    return rows.withColumn("_read", F.explode(passes(plan))).withColumns({"_pass": F.col("_read.pass"), "_moment": F.col("_read.moment")}).drop("_read")


def mix(docs: DataFrame, plan: Curriculum = DEFAULT, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each time that a
    document is read, range-sorted by the moment of reading.

    Columns may have any names.  Rows without words are left out, for they
    hold nothing to read; no rows give no rows.
    """
    masked = Masked(docs)
    rows = readings(placed(masked.df, plan, masked[id_col], masked[source_col], masked[text_col]), plan)
    return rows.orderBy("_moment", masked[id_col], "_pass").select(*masked.restored())


def timetable(rows: DataFrame, plan: Curriculum = DEFAULT, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``placed`` with ``moments`` and ``positions``: when the mix reads
    the document, and its ranks from 0 among all readings, which are
    range-sorted by moment.  Both are empty for a document never read.
    """
    kept = cut(rows)
    order = readings(kept, plan).select("_source_number", "_offset", "_pass", "_moment", F.col(id_col).alias("_id")).orderBy("_moment", "_id", "_pass")
    placed_at = with_position(order.select("_source_number", "_offset", "_moment"), "order")
    # documents with words of one source have distinct offsets
    per = placed_at.groupBy("_source_number", "_offset").agg(F.array_sort(F.collect_list(F.struct("position", "_moment"))).alias("_at"))  # max_repeat at most
    read = kept.where("_size > 0").join(per, ["_source_number", "_offset"], "left").unionByName(kept.where("_size <= 0").withColumn("_at", F.lit(None).cast("array<struct<position:bigint,_moment:double>>")))
    at = F.coalesce("_at", F.array().cast("array<struct<position:bigint,_moment:double>>"))
    return read.withColumns({"moments": F.transform(at, lambda x: x["_moment"]), "positions": F.transform(at, lambda x: x["position"])}).drop("_at")


def is_whole_read(rows: DataFrame) -> bool:
    """Whether a frame is files as they are read, with columns chosen at most."""
    plan = rows._jdf.queryExecution().analyzed()
    while plan.nodeName() == "Project" and plan.children().size() == 1:
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and bool(rows.inputFiles())


def with_position(rows: DataFrame, tag: str = "ordered") -> DataFrame:
    """``rows`` with ``position``, the rank from 0 in the order of the frame.

    For whole files that are just read that is the order in which they were
    written: a sorted frame is written range by range, so a row's rank is its
    place in its file plus the rows of the files before.  Any other frame,
    filtered, sorted or joined, is written first, in its own order.  A column
    named ``position`` is replaced.
    """
    if not is_whole_read(rows):
        rows = written(rows, tag)
    name = F.col("_metadata.file_name")
    file = F.concat_ws("/", *[F.lpad(F.regexp_extract(name, pattern, 1), 20, "0") for pattern in (r"^part-(\d+)", r"-c(\d+)\.[^/]*$")])
    mine = {c: f"_c{i}" for i, c in enumerate(rows.columns)}
    rows = rows.select(*[quoted(c).alias(n) for c, n in mine.items()], file.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = rows.groupBy("_file").agg(F.count("*").alias("_n")).select(F.col("_file"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = rows.join(F.broadcast(files), "_file")
    return rows.select(*[F.col(n).alias(c) for c, n in mine.items() if c != "position"], (F.col("_before") + F.col("_row")).alias("position"))


#: What ``placed`` and ``timetable`` make of ``documents`` by the default plan, in
#: DuckDB: one table of documents, one of readings.
TABLES = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), 'size ' || coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0))) AS o,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM sized GROUP BY source),
level AS (
  SELECT *, 2 * source_size AS cap,
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM per),
tgt AS (
  SELECT source, source_size, kind, CASE WHEN cap / weight < lv THEN cap::DOUBLE
    ELSE weight * max(CASE WHEN NOT cap / weight < lv THEN lv END) OVER () END AS target
  FROM level),
offs AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM sized),
docs AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.source, t.kind, d.off,
    (least(d.size, greatest(floor(t.target)::BIGINT - off, 0)) + least(d.size, greatest(floor(t.target)::BIGINT - t.source_size - off, 0)))::BIGINT AS taken
  FROM offs d JOIN tgt t ON d.source IS NOT DISTINCT FROM t.source),
shares AS (
  SELECT doc_id, source, kind, off, pass, (pass * source_size + off + size / 2) / target AS x
  FROM docs, (VALUES (0), (1)) p(pass) WHERE size > 0 AND pass * source_size + off + size / 2 <= target),
moments AS (
  SELECT *, CASE kind WHEN 0 THEN 2 * (x * 5.0::DOUBLE) / (7 + sqrt(49 - 8 * (x * 5.0::DOUBLE)))
    WHEN 1 THEN 2 * (x * 2.0::DOUBLE) / 4
    ELSE CASE WHEN x >= 0.25::DOUBLE THEN 0.5::DOUBLE + 2 * (x - 0.25::DOUBLE) / (0.75::DOUBLE + sqrt(0.5625::DOUBLE + 6 * (x - 0.25::DOUBLE)))
      ELSE 2 * x / (0.25::DOUBLE + sqrt(0.0625::DOUBLE + 2 * x)) END END AS moment
  FROM shares),
readings AS (SELECT *, row_number() OVER (ORDER BY moment, doc_id, pass) - 1 AS position FROM moments)
"""
ORACLE = TABLES + """
SELECT d.doc_id, d.size, d.source_size, d.target, d.taken, round(a.moment, 9) AS moment, a.position, round(b.moment, 9) AS moment_again, b.position AS position_again
FROM docs d LEFT JOIN readings a ON a.pass = 0 AND d.size > 0 AND a.off = d.off AND a.source IS NOT DISTINCT FROM d.source
LEFT JOIN readings b ON b.pass = 1 AND d.size > 0 AND b.off = d.off AND b.source IS NOT DISTINCT FROM d.source
"""
ORDER_ORACLE = TABLES + "SELECT doc_id, pass, round(moment, 9) AS moment, position FROM readings"
