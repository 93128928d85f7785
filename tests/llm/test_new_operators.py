"""Hard negatives, fill-in-middle and packing against brute force."""

import hashlib
import json
import random
import re

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trailmark.llm import ann, fim, hard_negatives, html_crf, langid, mixing, packing, quality, queries, sharding

# 11 --------------------------------------------------------------------------


def slow_negatives(rows, is_anchor, plan):
    """From ``(id, label, vector)`` rows, each counted once."""
    rows = sorted({(i, lab, tuple(v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    sizes = {}
    for _, _, v in rows:
        sizes[len(v)] = sizes.get(len(v), 0) + 1
    d = min(sizes, key=lambda k: (-sizes[k], k)) if sizes else 0
    rows = [(i, lab, [int(np.floor(float(x) * plan.scale)) for x in v]) for i, lab, v in rows if len(v) == d]
    anchors, out = {}, []
    for i, lab, v in rows:
        if is_anchor(i):
            anchors.setdefault(i, (lab, v))
    for a, (lab, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, m) for i, m, w in rows if i != a)
        same = [(i, -s) for s, i, m in scored if m == lab][: plan.positives]
        for nth, (p, ps) in enumerate(same, 1):
            fits = [(i, -s) for s, i, m in scored if m != lab and plan.low * ps <= 100 * -s <= plan.high * ps][: plan.negatives]
            out += [(a, p, r, i, ps, s, nth) for r, (i, s) in enumerate(fits, 1)]
    return sorted(out)


def mined(rows, plan=None, every=3, **names):
    return sorted(tuple(r) for r in hard_negatives.mine(rows, F.col("_id") % every == 0, plan, **names).collect())


@pytest.mark.parametrize("sizes", [(16_384, 1_024, 64), (7, 3, 2), (1, 1, 1)])
def test_negatives_brute_force(spark, sizes):
    rng = random.Random(5)
    block, group, at_once = sizes
    plan = hard_negatives.MiningPlan(positives=3, negatives=4, block_rows=block, group_anchors=group, at_once=at_once)
    data = [(i, rng.choice([0, 1, 1, 1, 2]), [rng.choice([0.0, 0.25, 0.5, 1.0]) + 0.5 for _ in range(3)]) for i in range(40)]
    data += [data[0], data[5], (6, 2, [1.0, 1.0, 1.0]), (9, 1, [0.25, 0.25, 0.75]), (41, None, [1.0] * 3), (None, 1, [1.0] * 3), (42, 1, None), (43, 1, [1.0, None, 1.0]), (45, 2, [float("nan")] * 3), (48, 2, [float("inf")] * 3), (51, 2, [1.0] * 4), (54, 1, [])]
    rows = spark.createDataFrame(data, "vec_id long, label int, embedding array<float>")
    want = slow_negatives(data, lambda i: i % 3 == 0, plan)
    assert len(want) > 30
    assert mined(rows, plan) == want


def test_negatives_of_clashing_names_large_numbers_and_nothing(spark):
    plan = hard_negatives.MiningPlan(positives=2, negatives=3)
    data = [(i, "xy"[i % 2], [1e6 * (i + 1) + 0.1, 3.5e5 * (i % 3), -1e4]) for i in range(12)]
    rows = spark.createDataFrame([(*r, 1, 2) for r in data], "`a.id` long, `_label` string, `v.v` array<double>, _block int, rank int")
    want = slow_negatives(data, lambda i: i % 3 == 0, plan)
    assert want and mined(rows, plan, id_col="a.id", label_col="_label", vector_col="v.v") == want
    assert mined(rows.limit(0), plan, id_col="a.id", label_col="_label", vector_col="v.v") == []
    with pytest.raises(ValueError, match="1 or more"):
        hard_negatives.MiningPlan(negatives=0)


def test_scores_are_exact():
    for most in (2**10, 2**25, 2**29, 2**40):
        rng = np.random.default_rng(2)
        a, x = rng.integers(-most, most, (3, 5)).astype(float), rng.integers(-most, most, (4, 5)).astype(float)
        want = [[sum(int(p) * int(q) for p, q in zip(r, s, strict=True)) for s in x] for r in a]
        assert hard_negatives.scores(a, x).tolist() == [[max(1 - 2**63, min(2**63 - 1, v)) for v in r] for r in want]


def test_limits_are_exact():
    plan = hard_negatives.MiningPlan()
    for p in [*range(-230, 231), 2**62 + 7, -(2**62) - 3]:
        low, high = (int(v[0]) for v in hard_negatives.limits(np.array([p]), plan))
        assert 100 * low >= 30 * p > 100 * (low - 1) and 100 * high <= 90 * p < 100 * (high + 1)


# 12 --------------------------------------------------------------------------

UNITS = re.compile(fim.UNIT_PATTERN)


def slow_fim(doc_id, text, plan):
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(s in text for s in plan.sentinels) or h[2] % 100 >= 100 - plan.plain:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = plan.sentinels
    if h[3] % 100 < plan.spm:
        return n, "spm", len(x), len(y), s + z + p + x + m + y
    return n, "psm", len(x), len(y), p + x + s + z + m + y


@pytest.mark.parametrize("plan", [fim.FimPlan(), fim.FimPlan(lanes=50, least=1, plain=10), fim.FimPlan("<fim_p>", "<fim_s>", "<mid>", lanes=7, least=3, plain=0)])
def test_fim_brute_force(plan):
    rng = random.Random(7)
    alphabet = [*"<<<>PSMfim_p aé文😀\t\n\x0b\x00", "<P", "<fim_", *plan.sentinels]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 5, 30]))) for _ in range(1500)]
    texts += ["", " ", "\n\n", "<P>", "x<M>", "<S", "< P>", " <P", "P>", "a " * 3000, "文" * 999]
    digests = [hashlib.sha256(f"{plan.seed}:{i}".encode()).hexdigest() for i in range(len(texts))]
    draws = np.array([[int(d[j : j + 8], 16) for j in range(0, 32, 8)] for d in digests])
    got = fim.rearranged([t.encode() for t in texts], draws, plan)
    forms = set()
    for i, (text, row) in enumerate(zip(texts, got.itertuples(index=False), strict=True)):
        n, form, x, y, out = slow_fim(i, text, plan)
        assert (row.n, row.form, row.output.decode()) == (n, form, out), text
        assert (None, None) == (x, y) if form == "plain" else (row.prefix_chars, row.middle_chars) == (x, y)
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}
    assert len(fim.rearranged([], draws[:0], plan)) == 0


def test_fim_of_odd_rows(spark, odd, none):
    plan = fim.FimPlan(plain=0)
    rows = fim.with_middle_last(odd, plan)
    assert rows.columns == [*odd.columns, "fim"]
    back = fim.restored(F.col("fim.output"), F.col("fim.form"), plan)
    got = rows.select("doc_id", "text", "fim.*", back.alias("back")).collect()
    assert len(got) == odd.count()
    for r in got:
        want = slow_fim(r["doc_id"], r["text"], plan)
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want
        assert r["back"] == (r["text"] or "")
    assert fim.with_middle_last(none).count() == 0
    dotted = odd.select(F.col("doc_id").alias("a.id"), F.col("text").alias("t.t"), F.lit(1).alias("fim"))
    assert fim.with_middle_last(dotted, plan, id_col="a.id", text_col="t.t").where("fim.n is null").count() == 0


def test_fim_plans_that_cannot_be_undone():
    for bad in (("<P>", "<P>", "<M>"), ("<P >", "<S>", "<M>"), ("", "<S>", "<M>"), ("<P>", "P<", "<M>")):
        with pytest.raises(ValueError):
            fim.FimPlan(*bad)


def test_fim_query_restores_every_text(spark, sf, docs):
    rows = queries.op12_fill_in_middle(spark, sf).join(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("want")), "doc_id")
    assert rows.where("restored_sha256 <> want or (form <> 'plain') <> (prefix_chars is not null)").count() == 0
    plan = queries.op12_fill_in_middle(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython ") == 1


# 13 --------------------------------------------------------------------------


def slow_pieces(text, size, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.public_vocabulary())
    t.encode_special_tokens = True
    ids = [*t.encode(text or "", add_special_tokens=False).ids, end]
    out, at = [], 0
    while at < len(ids):
        length = size
        while length > len(ids) - at:
            length //= 2
        out.append((at, length, ids[at : at + length], len(ids)))
        at += length
    return out


def check_numbers(rows, size):
    """Each sequence one power of two, numbered without gaps, longest first."""
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    lengths = [r["length"] for r in sorted(rows, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths, reverse=True)
    assert all(r["offset"] == 0 and r["length"] <= size and r["length"].bit_count() == 1 for r in rows)


@pytest.mark.parametrize("size", [1024, 8, 1])
def test_packing_brute_force(spark, odd, size):
    docs = odd.where("n_chars <> 7 or n_chars is null") if size == 1 else odd
    rows = packing.packed(docs, size=size, end_id=5).collect()
    check_numbers(rows, size)
    want = [(r["doc_id"], *p) for r in docs.select("doc_id", "text").collect() for p in slow_pieces(r["text"], size, 5)]
    got = [(r["doc_id"], r["start"], r["length"], packing.unpacked(r["ids"]).tolist(), r["doc_tokens"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_packing_query(spark, sf, docs):
    rows = queries.op13_packing(spark, sf)
    found = rows.collect()
    check_numbers(found, 1024)
    by_doc = {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
    import zlib

    for r in docs.where("doc_id % 5 = 0").select("doc_id", "text").collect():
        want = [(s, n, zlib.crc32(np.array(ids, "<u4").tobytes()), total) for s, n, ids, total in slow_pieces(r["text"], 1024, 0)]
        assert sorted((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in by_doc[r["doc_id"]]) == want
    assert len(by_doc) == docs.count()


def test_packing_without_broadcast_and_buckets(spark, docs, none, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    few = docs.limit(30).withColumnRenamed("doc_id", "d.id").withColumnRenamed("text", "t.t")
    rows = packing.packed(few, id_col="d.id", text_col="t.t")
    check_numbers(rows.collect(), 1024)
    packing.write_buckets(rows, str(tmp_path / "packed"))
    found = pq.read_table(tmp_path / "packed/bucket=64").to_pylist()
    assert found and all(len(r["ids"]) == 256 for r in found)
    assert packing.packed(none).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.packed(none, size=1000)
    with pytest.raises(ValueError, match="rename"):
        packing.packed(none.withColumnRenamed("doc_id", "offset"), id_col="offset")


def test_chunks_encode_as_whole_texts():
    rng, e = random.Random(1), packing.Encoder(packing.public_vocabulary(), 0)
    assert e.by_chunk
    for k in range(3000):
        text = "".join(rng.choice("ab  \n\t\x0b\x1c\x85\xa0 　'sé文1!<|>٣ŉ") for _ in range(rng.randint(0, 30))) + (" a<|endoftext|> b" if k % 9 == 0 else "")
        assert e(text) == np.array([*e.tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()


def test_other_vocabularies_encode_whole_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    path = packing.public_vocabulary().replace("byte_bpe_50k", "word_bpe_49k")
    e = packing.Encoder(path, 7)
    assert not e.by_chunk
    assert packing.unpacked(e("Some  Words")).tolist() == [*Tokenizer.from_file(path).encode("Some  Words", add_special_tokens=False).ids, 7]
    assert json.loads(e.tokenizer.to_str())["model"]["type"] == "BPE"


# 3 and 2 ---------------------------------------------------------------------


def test_shards_keep_every_column(spark, tmp_path):
    """Three arrivals of different columns, merged and the originals deleted."""
    tiers = sharding.Tiers(target_bytes=1 << 20, small_bytes=1000, fanout=2, arrival_rows=2)
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", tiers, order_col="t")
    store.append(spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string"))
    store.append(spark.createDataFrame([(3, "c", 1.5)], "id long, t string, `c.d` double"))
    store.append(spark.createDataFrame([(4, "z"), (5, None)], "id long, u string"))
    want = [(1, "a", None, None), (2, "b", None, None), (3, "c", 1.5, None), (4, None, None, "z"), (5, None, None, None)]
    got = lambda: sorted(tuple(r)[:4] for r in store.rows().collect())
    assert store.rows().columns == ["id", "t", "c.d", "u", "_shard", "_tier"] and got() == want
    last = store.compact()
    assert store.manifest().count() == 1 and got() == want
    assert len(store.expire()) == 3 and store.versions() == [last] and got() == want
    for bad in ("id string", "id long, T string"):
        with pytest.raises(ValueError, match="fit"):
            store.append(spark.createDataFrame([], bad))
    assert store.version() == last
    store.append(spark.createDataFrame([(6, "y")], "id long, u string"))
    store.compact()
    assert got() == [*want, (6, None, None, "y")]


def test_compaction_reads_the_planned_files_only(spark, tmp_path, monkeypatch):
    tiers = sharding.Tiers(target_bytes=40_000, small_bytes=500, fanout=2, arrival_rows=3000)
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", tiers)
    store.append(spark.range(9000).selectExpr("id", "md5(CAST(id AS STRING)) AS t").coalesce(1))
    read, one = [], sharding.ShardStore._read
    monkeypatch.setattr(sharding.ShardStore, "_read", lambda self, files, schema: read.extend(files) or one(self, files, schema))
    assert store.compact() == 1 and read == []  # full-sized shards stay alone
    for i in range(2):
        store.append(spark.createDataFrame([(-i, "small")], "id long, t string"))
    read.clear()
    store.compact()
    planned = [f for f in read if "/" in f]
    assert len(planned) == 2 and all(f.startswith("arrival-0000000") and not f.startswith("arrival-00000001/") for f in planned)
    assert store.rows().count() == 9002


def test_positions_of_any_frame(spark, tmp_path):
    spark.range(20).selectExpr("id", "id % 3 AS position").repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(f"{tmp_path}/r")
    read = spark.read.parquet(f"{tmp_path}/r")
    ranks = lambda df: [(r["id"], r["position"]) for r in mixing.with_position(df).orderBy("position").collect()]
    assert ranks(read) == [(i, i) for i in range(20)] and ranks(read.select("id")) == ranks(read)
    odd = sorted(ranks(read.where("id % 2 = 1").orderBy("id")))
    assert odd == [(2 * i + 1, i) for i in range(10)]
    assert sorted(p for _, p in ranks(read.where("id % 2 = 1"))) == list(range(10))
    assert ranks(read.orderBy(F.desc("id"))) == [(19 - i, i) for i in range(20)]
    assert sorted(p for _, p in ranks(read.join(spark.range(5), "id"))) == list(range(5))
    assert sorted(p for _, p in ranks(read.unionAll(read))) == list(range(40)) and ranks(read.limit(0)) == []


def test_schedules_without_weight_and_with_steps(spark):
    none, step = mixing.Schedule(((0.0, 0.0), (1.0, 0.0))), mixing.Schedule(((0.0, 1.0), (0.5, 1.0), (0.5, 3.0), (1.0, 3.0)))
    assert none.integral() == 0 and step.integral() == 2
    rows = spark.createDataFrame([(i, "abc"[i % 3], " ".join("w" * 5)) for i in range(90)], "doc_id long, source string, text string")
    plan = mixing.Curriculum((none, step))
    got = mixing.placed(rows, plan).groupBy("source").agg(F.max("_target").alias("t"), F.sum("_taken").alias("n"), F.sum("_size").alias("s")).orderBy("source").collect()
    # b is the only source of any weight: it stops at twice its size
    assert [(r["t"], r["n"]) for r in got] == [(0.0, 0), (2.0 * got[1]["s"], 2 * got[1]["s"]), (0.0, 0)]
    moments = sorted(r["_moment"] for r in mixing.readings(mixing.placed(rows, mixing.Curriculum((step,))), mixing.Curriculum((step,))).collect())
    # a quarter of the demand before the step at one half
    assert abs(sum(m < 0.5 for m in moments) / len(moments) - 0.25) < 0.02 and mixing.mix(rows, mixing.Curriculum((none,))).count() == 0
    for bad in (((0.0, 1.0),), ((0.0, 1.0), (0.9, 1.0)), ((0.0, 1.0), (0.6, 1.0), (0.5, 1.0), (1.0, 1.0)), ((0.0, -1.0), (1.0, 1.0))):
        with pytest.raises(ValueError, match="knots"):
            mixing.Schedule(bad)


# 1 ---------------------------------------------------------------------------


def test_neighbours_in_double_precision(spark):
    """Vectors that single precision can't tell apart, under dotted names."""
    rows = [(i, [1e8 + 0.25 * i, 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "`v.id` long, `v.v` array<double>")
    got = ann.nearest(df, F.col("_id") % 20 == 0, k=3, id_col="v.id", vector_col="v.v").orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 0.25), (0, 2, 0.5), (0, 3, 0.75), (20, 19, 0.25), (20, 21, 0.25), (20, 18, 0.5)]


# 4, 6 and 10 -----------------------------------------------------------------


def test_dotted_names(spark, sf, docs):
    few = docs.where("doc_id < 60").select(F.col("doc_id").alias("d.id"), F.col("lang").alias("l.l"), F.col("text").alias("t.t"))
    model = langid.train(few, id_col="d.id", lang_col="l.l", text_col="t.t")
    plain = langid.train(docs.where("doc_id < 60"))
    got = {r[0]: r[1] for r in langid.with_language(few, model, text_col="t.t").select("`d.id`", "prediction.lang").collect()}
    assert got == {r[0]: r[1] for r in langid.with_language(docs.where("doc_id < 60"), plain).select("doc_id", "prediction.lang").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnsRenamed({"doc_id": "d.id", "quality": "q.q"})
    good = quality.train(docs.withColumnsRenamed({"doc_id": "d.id", "text": "t.t"}), labels, id_col="d.id", text_col="t.t", label_col="q.q")
    assert few.select(quality.score_column(few, good, text_col="t.t").alias("s")).where("s BETWEEN 0 AND 1").count() == few.count()
    pages = spark.createDataFrame([("<html><body><article><p>Some words of an article that is long enough to stay.</p></article></body></html>",)], "`h.h` string")
    assert html_crf.with_main_text(pages, html_col="h.h").select("main.n_chars").first()[0] > 0


def _tight():
    """A cloud of near copies within rows that are scattered wide."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 16))
    x[::2] = 3 + 1e-3 * x[::2]
    return x


def _strangers():
    """Clusters, and queries that lie outside of all of them."""
    rng = np.random.default_rng(6)
    x = 4 * rng.normal(size=(60, 16))[rng.integers(60, size=6000)] + 0.3 * rng.normal(size=(6000, 16))
    x[::50] = 4 * rng.normal(size=(120, 16))
    return x


def _offset():
    """Rows far from the origin, nearer to each other than single precision squares tell."""
    return 3000 + np.random.default_rng(7).normal(size=(3000, 16))


@pytest.mark.parametrize("made", [_tight, _strangers, _offset])
def test_neighbours_recall_on_other_rows(spark, made):
    x = made().astype(np.float32)
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    found = ann.nearest(rows, F.col("_id") % 50 == 0).toPandas()
    exact = []
    for q in range(0, len(x), 50):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        exact += [(q, v) for v in np.lexsort((np.arange(len(x)), d))[:10]]
    exact = pd.DataFrame(exact, columns=["query_id", "vec_id"])
    assert len(found) == len(exact) and ann.recall(found, exact) >= 0.95
