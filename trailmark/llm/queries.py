"""The operators bound to the synthetic tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, fim, hard_negatives, html_crf, langid, line_dedup, mixing, packing, pylm, quality, sharding, simhash
from .common import remainder, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("_id") % 100 == 0)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    return mixing.placed(sized, size_col="size")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document, when it reads it, and
    at which position in the order of reading, for the first and second time.
    """
    rows = mixing.timetable(_placed(spark, sf_dir))
    at = lambda c, k: F.try_element_at(c, F.lit(k))
    return rows.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"),
        F.round(at("moments", 1), 9).alias("moment"), at("positions", 1).alias("position"), F.round(at("moments", 2), 9).alias("moment_again"), at("positions", 2).alias("position_again"),
    )


def op2_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reading of a document: its pass, moment and position in the mix."""
    rows = mixing.readings(_placed(spark, sf_dir)).orderBy("_moment", "doc_id", "_pass")
    rows = mixing.with_position(rows.select("doc_id", F.col("_pass").alias("pass"), F.col("_moment").alias("moment")), "order")
    return rows.withColumn("moment", F.round("moment", 9))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document after an append and a compaction."""
    rows = sharding.shard(table(spark, sf_dir, "documents"), scratch_path(spark, "shards"))
    return rows.select("doc_id", "n_chars", F.col("_shard").alias("shard"), F.col("_tier").alias("tier"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    pages = html_crf.with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "main.text", "main.n_chars")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without cross-site boilerplate lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    rows = line_dedup.without_boilerplate(docs.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long")))
    return rows.select("doc_id", "n_lines", F.col("removed_lines").alias("n_removed"), F.sha2("text", 256).alias("text_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    model = langid.train(docs, may_learn=~held_out)
    rows = langid.with_language(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out.alias("held_out"), F.col("prediction.lang").alias("lang_pred"), F.col("prediction.score").alias("score"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the language model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pylm.score(docs, remainder("doc_id", 7) == 2)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items found in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.with_hits(docs, table(spark, sf_dir, "benchmark")).select("doc_id", *decontam.digest())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), may_learn=remainder("doc_id", 4) != 2)
    rows = docs.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), quality.score_column(docs, model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every positive of every hundredth vector; every
    seventh label is moved on by one first.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("_id") % 100 == 0)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every document is rearranged, and digests of that and of the text
    rebuilt from it.
    """
    rows = fim.with_middle_last(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fim.*")
    digest = lambda c: F.sha2(c, 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence that holds each piece of every document."""
    rows = packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ``corpus_pipeline`` over the documents."""
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ann": op1_ann,
        "op2_mixing": op2_mixing,
        "op2_order": op2_order,
        "op3_sharding": op3_sharding,
        "op4_html_extraction": op4_html_extraction,
        "op5_line_dedup": op5_line_dedup,
        "op6_language_id": op6_language_id,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_pitman_yor": op8_pitman_yor,
        "op9_decontamination": op9_decontamination,
        "op10_quality": op10_quality,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_packing": op13_packing,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    sql = {"op2_mixing": mixing.ORACLE, "op2_order": mixing.ORDER_ORACLE, "op5_line_dedup": line_dedup.ORACLE, "op9_decontamination": decontam.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE, "op12_fill_in_middle": fim.ORACLE}
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql
