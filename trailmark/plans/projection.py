"""The relational tables read as a package graph.

Parts are packages with one version each, published when first ordered; an
order is its customer, a service, pinning the parts.  The supplier of most of
a part's lines maintains it (the smaller key on a tie).  A part depends on the
part of the next line of an order if that has a larger key, so dependencies
have no cycles.  A part's advisory is published when it is first returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import Graph

#: Edge ids are made of both ends, those of pins of the day as well.
SPAN = 10_000_000
DAYS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(df: DataFrame, col: str) -> Column:
    """Epoch milliseconds; times without a zone are taken as UTC whatever the
    session's zone is.
    """
    if dict(df.dtypes)[col] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
    return F.unix_millis(col)


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src, dst, resolved_at_ms)``: customer, part and time, one per line."""
    o = table(spark, sf_dir, "orders")
    o = o.select("o_orderkey", F.col("o_custkey").alias("src"), epoch_ms(o, "o_orderdate").alias("resolved_at_ms"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("dst"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("src", "dst", "resolved_at_ms")


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pins as edges."""
    day = F.expr("resolved_at_ms div 86400000")
    return pins(spark, sf_dir).distinct().select(((F.col("src") * SPAN + F.col("dst")) * DAYS + day).alias("edge_id"), "src", "dst", "resolved_at_ms")


def resolves_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    a = li.select("l_orderkey", F.col("l_partkey").alias("src"), (F.col("l_linenumber") + 1).alias("l_linenumber"))
    b = li.select("l_orderkey", F.col("l_partkey").alias("dst"), "l_linenumber")
    pairs = a.join(b, ["l_orderkey", "l_linenumber"]).where("src < dst").select("src", "dst").distinct()
    return pairs.select((F.col("src") * SPAN + F.col("dst")).alias("edge_id"), "src", "dst")


def maintains(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    best = n.groupBy(F.col("l_partkey").alias("dst")).agg(F.max_by("l_suppkey", F.struct("n", -F.col("l_suppkey"))).alias("src"))
    return best.select((F.col("src") * SPAN + F.col("dst")).alias("edge_id"), "src", "dst")


def part_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, published_at_ms, disclosed_at_ms, lines)`` of ordered parts."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    o = o.select("o_orderkey", epoch_ms(o, "o_orderdate").alias("at_ms"))
    li = li.select("l_orderkey", F.col("l_partkey").alias("id"), "l_returnflag", epoch_ms(li, "l_shipdate").alias("ship_ms"))
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("id").agg(F.min("at_ms").alias("published_at_ms"), F.min(F.when(F.col("l_returnflag") == "R", F.col("ship_ms"))).alias("disclosed_at_ms"), F.count("*").alias("lines"))


def project(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> Graph:
    """The whole graph, lazily; ``part_facts`` may be given where they are
    written down already.
    """
    part = table(spark, sf_dir, "part")
    facts = part_facts(spark, sf_dir) if facts is None else facts
    parts = part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("npm:part-"), F.col("p_partkey").cast("string")).alias("key"), F.lit("npm").alias("ecosystem"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("name"), "p_size")
    both = parts.join(facts, "id", "left")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    same = part.select(F.col("p_partkey").alias("edge_id"), F.col("p_partkey").alias("src"), F.col("p_partkey").alias("dst"))
    stated = part.select(F.col("p_partkey").alias("edge_id"), F.col("p_partkey").alias("src"), F.col("p_partkey").alias("dst"), F.concat(F.col("p_size").cast("string"), F.lit(".0.0")).alias("introduced"), F.lit(None).cast("string").alias("fixed"))
    nodes = {
        "packages": both.select("id", "key", "ecosystem", "name", F.col("lines").alias("weekly_downloads")),
        "versions": both.select("id", F.concat("key", F.lit(":"), F.col("p_size").cast("string"), F.lit(".0.0")).alias("key"), "ecosystem", "name", F.concat(F.col("p_size").cast("string"), F.lit(".0.0")).alias("version"), "published_at_ms", (F.col("p_size") > 40).alias("has_install_script")),
        "maintainers": supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("npm:"), F.col("s_name")).alias("key"), F.lit("npm").alias("ecosystem"), F.col("s_name").alias("username")),
        "services": customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("svc:"), F.col("c_name")).alias("key"), F.col("c_name").alias("name"), F.lit("seed").alias("source")),
        "advisories": both.where("disclosed_at_ms IS NOT NULL").select("id", F.concat(F.lit("GHSA-"), F.col("id").cast("string")).alias("key"), F.concat(F.lit("GHSA-"), F.col("id").cast("string")).alias("ghsa_id"), F.col("disclosed_at_ms").alias("published_at_ms"), F.col("disclosed_at_ms").alias("modified_at_ms"), F.lit("").alias("summary")),
    }
    hit = facts.where("disclosed_at_ms IS NOT NULL").select("id")
    edges = {
        "version_of": same, "resolves_to": resolves_to(spark, sf_dir), "maintains": maintains(spark, sf_dir), "resolved": resolved(spark, sf_dir),
        "affects": stated.join(hit, F.col("src") == F.col("id"), "left_semi"), "affects_version": same.join(hit, F.col("src") == F.col("id"), "left_semi"),
    }
    level = F.when(F.col("p_size") % 3 == 0, 2).when(F.col("p_size") % 3 == 1, 1).otherwise(0)
    coverage = part.select(F.lit("package").alias("subject_kind"), F.concat(F.lit("npm:part-"), F.col("p_partkey").cast("string")).alias("key"), level.alias("level"))
    return Graph(spark, nodes, edges, coverage)


def most_depended_on(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """``(ordinal, node)``: the parts that most others depend on."""
    n = resolves_to(spark, sf_dir).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "node").limit(k)
    return top.select((F.row_number().over(Window.orderBy(F.desc("n"), "node")) - 1).cast("long").alias("ordinal"), "node")  # k rows


def named_packages(spark: SparkSession, sf_dir: str, separator: str = "-") -> DataFrame:
    """``(ecosystem, name, weekly_downloads)`` by part name and brand number."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit(separator)), F.lit(separator), F.substring("p_brand", 7, 9))
    return part.join(n, "p_partkey", "left").groupBy(name.alias("name")).agg(F.sum(F.coalesce("n", F.lit(0))).alias("weekly_downloads")).select(F.lit("npm").alias("ecosystem"), "name", "weekly_downloads")


def plain_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by part name alone."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return part.join(n, "p_partkey", "left").groupBy(F.replace("p_name", F.lit(" "), F.lit("-")).alias("name")).agg(F.sum(F.coalesce("n", F.lit(0))).alias("weekly_downloads")).select(F.lit("npm").alias("ecosystem"), "name", "weekly_downloads")
