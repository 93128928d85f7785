"""SimHash near-duplicate detection with pigeonhole blocks.

Fingerprints are cut into blocks; two fingerprints within the distance bound
agree on some selection of blocks, so they meet under the key made of those
blocks.  Every key's rows are compared in bounded chunks and each task emits a
spanning forest of the links it found instead of the links themselves, so a
large group of near copies costs rows in proportion to its members.  Links are
then closed over by alternating large-star and small-star steps.

``drop_near_duplicates`` goes by the similarity of shingle sets: wider
fingerprints of these sets propose in the same way what to compare, and each
link is verified exactly.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Masked, cut, quoted, release_shuffles, text_batches

SEED = 42
#: Shingles whose bits are counted at once; bounds the memory of a long text.
COUNT_CHUNK = 1 << 14


@dataclass(frozen=True)
class SimHashPlan:
    """What a fingerprint is made of and when two of them link.

    ``shingle`` words make a shingle, fingerprints have ``bits`` bits and link
    at ``max_distance`` or fewer differing bits.  ``keys`` lists, for each
    blocking key, the bit positions that it is made of.
    """

    shingle: int
    bits: int
    max_distance: int
    keys: tuple[tuple[int, ...], ...]

    @property
    def words(self) -> int:
        return self.bits // 64


def exact_plan(shingle: int = 3, bits: int = 64, max_distance: int = 3, blocks: int = 5) -> SimHashPlan:
    """Keys that lose no pair: ``max_distance`` differing bits spoil at most as
    many blocks, so any two linked fingerprints agree on some
    ``blocks - max_distance`` blocks, and there is a key for each such choice.
    """
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    parts = [tuple(range(a, b)) for a, b in itertools.pairwise(edges)]
    chosen = itertools.combinations(parts, blocks - max_distance)
    return SimHashPlan(shingle, bits, max_distance, tuple(sum(c, ()) for c in chosen))


#: Fingerprints that share a key by chance, on average, at most.
KEY_ROWS = 32


def plan_for(n: int, **how) -> SimHashPlan:
    """The exact plan with the fewest keys that are wide enough for ``n``
    fingerprints: more rows get more blocks, of which more must agree.
    """
    for blocks in range(4, 9):
        plan = exact_plan(blocks=blocks, **how)
        if n <= KEY_ROWS << min(map(len, plan.keys)):
            break
    return plan


#: The same where a fingerprint has hundreds of keys.
PROPOSING_ROWS = 256
#: Bits of the fingerprints that propose which sets to compare.
WIDE_BITS = 512
#: Of two sets at the similarity sought, this share may agree on no key.
LOSS = 1e-3


def proposing_plan(n: int, least: float, shingle: int, seed: int = 20) -> SimHashPlan:
    """Keys for pairs of sets with a Jaccard similarity of ``least``.

    Such a pair differs in a share p = arccos(2s / (1 + s)) / pi of its bits,
    binomially, which is far too many for blocks that lose nothing.  Keys are
    drawn at random instead, wide enough that ``n`` fingerprints fall apart,
    and as many as leave ``LOSS`` of the pairs without a common one.
    """
    p = math.acos(2 * least / (1 + least)) / math.pi
    width = max(12, math.ceil(math.log2(max(n, 1) / PROPOSING_ROWS)))
    d = np.arange(WIDE_BITS + 1)
    log_pmf = np.array([math.lgamma(WIDE_BITS + 1) - math.lgamma(k + 1) - math.lgamma(WIDE_BITS - k + 1) for k in d]) + d * math.log(p) + (WIDE_BITS - d) * math.log1p(-p)
    agree = (1 - d / WIDE_BITS) ** width
    count = 8
    while (np.exp(log_pmf) * (1 - agree) ** count).sum() > LOSS:
        count += max(1, count // 8)
    rng = np.random.default_rng(seed)
    # the distance is taken over the first words of a fingerprint, 4.5 deviations above its mean
    held = PROBE_BYTES * 8
    most = math.ceil(held * p + 4.5 * math.sqrt(held * p * (1 - p)))
    return SimHashPlan(shingle, WIDE_BITS, most, tuple(tuple(rng.choice(WIDE_BITS, width, replace=False).tolist()) for _ in range(count)))


#: Bytes of a fingerprint that go with its keys to be compared.
PROBE_BYTES = 16


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each ``size``-word shingle of a text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - size] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def _widened(h: np.ndarray, words: int) -> np.ndarray:
    """(n, words) 64-bit values: the hashes, then independent mixes of them."""
    out = np.empty((len(h), words), np.uint64)
    out[:, 0] = h
    for k in range(1, words):
        x = h + np.uint64((0x9E3779B97F4A7C15 * k) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def fingerprint(text: bytes | None, plan: SimHashPlan) -> bytes:
    """Big-endian fingerprint; a bit is 1 if set in over half the hashes."""
    return fingerprint_of(shingle_hashes(text or b"", plan.shingle), plan)


def fingerprint_of(h: np.ndarray, plan: SimHashPlan, fair: bool = False) -> bytes:
    """The same of shingle hashes.  ``fair`` gives bits that are set in just
    half of them the value of a hash of all, since sets of few shingles would
    else be alike in their zeros.
    """
    ones = np.zeros(plan.bits, np.int64)
    for at in range(0, len(h), COUNT_CHUNK):
        part = _widened(h[at : at + COUNT_CHUNK], plan.words).astype(">u8").view(np.uint8)
        ones += np.unpackbits(part.reshape(-1, plan.bits // 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = ones * 2 > len(h)
    if fair and len(h):
        every = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED)], np.uint64)
        toss = np.unpackbits(_widened(every, plan.words).astype(">u8").view(np.uint8)).astype(bool)
        bits |= (ones * 2 == len(h)) & toss
    return np.packbits(bits).tobytes()


def with_fingerprint(docs: DataFrame, plan: SimHashPlan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp BINARY)`` of every row; a null or empty text has all bits 0."""
    text_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, plan) for t in texts], dtype=object)

    return docs.select(quoted(id_col).alias("doc_id"), fp(quoted(text_col).cast("binary")).alias("fp"))


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same connectivity in fewer links: each node with its smallest one."""
    nodes, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    ia, ib = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[ia], label[ib])
        if (low == label[ia]).all() and (low == label[ib]).all():
            break
        for side in (ia, ib):
            np.minimum.at(label, label[side], low)
            np.minimum.at(label, side, low)
        while (label != label[label]).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links(group: np.ndarray, node: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of equal ``group``, which lie side by side."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    held, step, at = 0, 1, np.arange(len(group) - 1)
    while len(at):
        at = at[at + step < len(group)]
        at = at[group[at + step] == group[at]]
        near = at[np.bitwise_count(fps[at] ^ fps[at + step]).sum(axis=1) <= most]
        if len(near):
            a.append(node[near])
            b.append(node[near + step])
            held += len(near)
        if held > 1 << 20:
            x, y = spanning_forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], 0
        step += 1
    return spanning_forest(np.concatenate(a), np.concatenate(b))


def fingerprint_links(classes: DataFrame, plan: SimHashPlan, chunk: int = 1024, hot_broadcast: int = 100_000) -> DataFrame:
    """Links ``(a, b)``, b < a, that connect the same nodes as all links do.

    ``classes`` is ``(node LONG, fp BINARY)``, one row per distinct
    fingerprint.  A key with more than ``chunk`` fingerprints is cut into
    chunks by hash, and each pair of chunks is compared on its own.  Of
    fingerprints over PROBE_BYTES the distance is that of their first bytes.
    """
    picks = [np.array(bits) for bits in plan.keys]
    width = min(plan.bits // 8, PROBE_BYTES)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bits = np.unpackbits(np.frombuffer(b"".join(pdf["fp"]), np.uint8).reshape(-1, plan.bits // 8), axis=1).astype(np.int64)
            probes = [fp[:width] for fp in pdf["fp"]]
            for k, pick in enumerate(picks):
                key = bits[:, pick] @ (1 << np.arange(len(pick), dtype=np.int64))
                yield pd.DataFrame({"key": key * len(picks) + k, "node": pdf["node"], "fp": probes})

    rows = classes.mapInPandas(keyed, "key long, node long, fp binary")
    hot = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")))
    n_hot = hot.count()
    if n_hot:
        rows = rows.join(F.broadcast(hot) if n_hot <= hot_broadcast else hot, "key", "left")
        own = F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int")
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
        rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "fp")
    else:
        rows = rows.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "fp")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    most = plan.max_distance

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def out(pdf: pd.DataFrame) -> pd.DataFrame:
            ids = pdf[["key", "i", "j"]].to_numpy()
            group = np.concatenate(([0], np.cumsum((ids[1:] != ids[:-1]).any(axis=1))))
            fps = np.frombuffer(b"".join(pdf["fp"]), np.uint64).reshape(-1, width // 8)
            x, y = _links(group, pdf["node"].to_numpy(), fps, most)
            return pd.DataFrame({"a": x, "b": y})

        for pdf in batches:
            pdf = pdf if rest is None else pd.concat((rest, pdf), ignore_index=True)
            last = (pdf[["key", "i", "j"]] == pdf[["key", "i", "j"]].iloc[-1]).all(axis=1)
            rest = pdf[last]
            if len(rest) < len(pdf):
                yield out(pdf[~last])
        if rest is not None:
            yield out(rest)

    return rows.mapInPandas(compared, "a long, b long").distinct()


#: Neighbours from which on a node is a hub, and hubs that are broadcast.
HUB, BROADCAST_HUBS = 512, 200_000
#: Links that a task holds at once to make a spanning forest of them.
FOREST_LINKS = 1 << 20


def _with_low(rows: DataFrame, low: DataFrame) -> DataFrame:
    """``rows (a, b)`` with ``m`` of ``low (a, m, n)``, n being the rows of a.

    Rows of hubs get it by broadcast, so that they stay where they are; their
    number is counted first.  If there are more, no single one weighs much.
    """
    hubs = low.where(F.col("n") >= HUB).select("a", "m")
    n_hubs = hubs.count()
    if not 0 < n_hubs <= BROADCAST_HUBS:
        return rows.join(low.select("a", "m"), "a")
    rest = rows.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(low.where(F.col("n") < HUB).select("a", "m"), "a")
    return rows.join(F.broadcast(hubs), "a").unionByName(rest)


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in ``links (a, b)``.

    Each task first turns its links into spanning forests.  Large-star and
    small-star steps then alternate until every node has one link, to a node
    that has none; all of these keep connectivity, and links go to smaller
    nodes only, so that node is the smallest of its component.  Rows are cut
    by a checkpoint each round.  Links from a node to itself and repeated ones
    change nothing; no links give no rows.
    """

    def forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, rows = [], 0

        def out() -> pd.DataFrame:
            links = pd.concat(rest)
            x, y = spanning_forest(links["a"].to_numpy(), links["b"].to_numpy())
            return pd.DataFrame({"a": x, "b": y})

        for pdf in batches:
            rest.append(pdf)
            rows += len(pdf)
            if rows >= FOREST_LINKS:
                yield out()
                rest, rows = [], 0
        if rows:
            yield out()

    def settled(e: DataFrame) -> bool:
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return ends.where("up > 1 OR (up > 0 AND down > 0)").count() == 0

    def large(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")).persist()
        held.append(low)
        # only rows towards larger nodes give links, so only these need the least one
        return _with_low(e.select(F.col("b").alias("a"), F.col("a").alias("b")), low).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def small(e: DataFrame) -> DataFrame:
        low = e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).persist()
        held.append(low)
        moved = _with_low(e, low).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(low.select("a", F.col("m").alias("b"))).distinct()

    spark, held = links.sparkSession, []
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    edges = cut(edges.coalesce(spark.sparkContext.defaultParallelism).mapInPandas(forests, "a long, b long").distinct())
    while not settled(edges):
        edges = cut(small(cut(large(edges))))
        while held:
            held.pop().unpersist()
        release_shuffles(spark)  # a round leaves nothing but its edges
    tops = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)


def near_duplicates(docs: DataFrame, plan: SimHashPlan | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp BINARY, component_id)`` of every row of ``docs``.

    Null and empty texts share the zero fingerprint and link like any other.
    Repeated rows give repeated rows; rows of one id with several texts are
    apart unless their texts link.  A row with a null id takes part in no
    link; its component is that of its fingerprint's other rows, or null.
    Other columns of ``docs`` are not read.  Without ``plan`` the keys are as
    wide as the number of fingerprints asks for.
    """
    base = plan or exact_plan()
    fps = cut(with_fingerprint(docs, base, id_col, text_col))
    node = F.conv(F.hex("fp"), 16, -10).cast("long") if base.bits == 64 else F.xxhash64("fp")
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("node", node))
    links = fingerprint_links(classes.where("first IS NOT NULL").select("node", "fp"), plan or plan_for(classes.count()))
    joined = cut(classes.join(connected_components(links), "node", "left").select("fp", "first", F.coalesce("component", "node").alias("component")))
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    found = joined.join(least, "component").select("fp", "component_id")
    return fps.join(found, "fp").select("doc_id", "fp", "component_id")


def similar_links(node: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same sets as all pairs with a Jaccard similarity
    of ``least`` or more do.

    A set not reached yet is compared with all others; once each is reached,
    only those outside the largest component can add a link.
    """
    sizes = np.array([len(x) for x in sets])
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    seen = np.zeros(len(words), bool)
    label = np.arange(len(sets))
    done = np.zeros(len(sets), bool)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def compare(i: int) -> None:
        own = flat[starts[i] : starts[i] + sizes[i]]
        seen[own] = True
        both = np.add.reduceat(seen[flat], starts, dtype=np.int64)
        seen[own] = False
        near = np.flatnonzero(both >= least * (sizes + sizes[i] - both))
        near = near[near != i]
        done[i] = True
        if len(near):
            a.append(np.full(len(near), node[i]))
            b.append(node[near])
            label[np.isin(label, label[near])] = label[i]

    for i in range(len(sets)):
        if label[i] == i and (label == i).sum() == 1:
            compare(i)
    names, members = np.unique(label, return_counts=True)
    if len(names) > 1:
        for i in np.flatnonzero((label != names[members.argmax()]) & ~done).tolist():
            compare(i)
    return spanning_forest(np.concatenate(a), np.concatenate(b))


def _set_of(text: bytes | None, shingle: int) -> tuple[np.ndarray, int]:
    """The shingle set of a text and a number that names the set."""
    h = np.unique(shingle_hashes(text or b"", shingle))
    return h, int(np.array(xxhash.xxh64_intdigest(h.tobytes(), SEED), np.uint64).view(np.int64))


def similar_texts(docs: DataFrame, shingle: int = 5, least: float = 0.8, chunk: int = 1024, chunk_hashes: int = 1 << 21) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, node)`` of every row of ``docs (doc_id, text)`` and ``(node,
    component, keeper)`` of every set of shingles: the smallest doc_id among
    the sets that it is connected with by links of an exact Jaccard similarity
    of ``least`` or more.

    SimHash fingerprints only propose which sets to compare.  Proposals are
    closed over, and all pairs within one such component are compared; one
    with more than ``chunk`` sets or ``chunk_hashes`` shingles is cut into
    chunks, and each pair of chunks is compared on its own.
    """
    text_batches(docs.sparkSession)
    shape = SimHashPlan(shingle, WIDE_BITS, 0, ())

    @F.pandas_udf("node long, n int, fp binary")
    def described(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            h, node = _set_of(text, shingle)
            rows.append((node, len(h), fingerprint_of(h, shape, fair=True)))
        return pd.DataFrame(rows, columns=["node", "n", "fp"])

    marked = cut(docs.select("doc_id", described(F.col("text").cast("binary")).alias("s")).select("doc_id", "s.node", "s.n", "s.fp"))
    classes = cut(marked.where("doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp")))
    plan = proposing_plan(classes.count(), least, shingle)
    proposed = fingerprint_links(classes.where("n > 0").select("node", "fp"), plan, chunk)
    members = cut(connected_components(proposed).join(classes.select("node", "first", "n"), "node"))
    parts = F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("n") / chunk_hashes)).cast("int")
    members = members.join(members.groupBy("component").agg(parts.alias("chunks")), "component").select("component", "chunks", F.col("node").alias("expected"), "first")
    wanted = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(members, F.col("doc_id") == F.col("first"))

    def with_set(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [_set_of(t, shingle) for t in pdf["text"]]
            out = pd.DataFrame({"component": pdf["component"], "chunks": pdf["chunks"], "node": pdf["expected"], "hashes": [h.tobytes() for h, _ in sets]})
            yield out[np.array([n for _, n in sets], np.int64) == pdf["expected"].to_numpy()]  # a doc_id may have several texts

    sets = wanted.select("component", "chunks", "expected", "text").mapInPandas(with_set, "component long, chunks int, node long, hashes binary")
    sets = sets.withColumn("own", F.pmod(F.xxhash64("node"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    sets = sets.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "hashes")
    sets = sets.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def out(pdf: pd.DataFrame) -> pd.DataFrame:
            ids = pdf[["component", "i", "j"]].to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]).any(axis=1), [True])))
            node, hashes = pdf["node"].to_numpy(), [np.frombuffer(h, np.uint64) for h in pdf["hashes"]]
            found = [similar_links(node[x:y], hashes[x:y], least) for x, y in itertools.pairwise(edges.tolist())]
            return pd.DataFrame({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([y for _, y in found])})

        for pdf in batches:
            pdf = pdf if rest is None else pd.concat((rest, pdf), ignore_index=True)
            last = (pdf[["component", "i", "j"]] == pdf[["component", "i", "j"]].iloc[-1]).all(axis=1)
            rest = pdf[last]
            if len(rest) < len(pdf):
                yield out(pdf[~last])
        if rest is not None:
            yield out(rest)

    closed = connected_components(sets.mapInPandas(compared, "a long, b long"))
    joined = cut(classes.select("node", "first").join(closed, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component")))
    keepers = joined.groupBy("component").agg(F.min("first").alias("keeper"))
    return marked.select("doc_id", "node"), joined.join(keepers, "component").select("node", "component", "keeper")


def drop_near_duplicates(docs: DataFrame, least: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with
    the smallest doc_id.  Texts link if ``least`` or more of the five-word
    shingles that either has are in both; null and empty texts are alike.

    Rows without a doc_id stay.  Rows of one doc_id count each by its own
    text: those in several groups stay or go with their group.
    """
    masked = Masked(docs)
    key, text = masked[id_col], masked[text_col]
    rows, keepers = similar_texts(masked.df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), shingle, least)
    fate = cut(rows.where("doc_id IS NOT NULL").join(keepers, "node").select("doc_id", "node", "component", (F.col("doc_id") == F.col("keeper")).alias("stays")))
    repeated = cut(fate.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(key)))
    gone = fate.where("NOT stays").select(F.col("doc_id").alias(key))
    kept = masked.df.join(gone.unionByName(repeated).distinct(), key, "left_anti").select(*masked.restored())
    if repeated.isEmpty():
        return kept

    @F.pandas_udf("long")
    def named(texts: pd.Series) -> pd.Series:
        return pd.Series([_set_of(t, shingle)[1] for t in texts], dtype="int64")

    again = masked.df.join(repeated, key, "left_semi").withColumn("_node", named(F.col(text).cast("binary")))
    stays = fate.where("stays").select(F.col("doc_id").alias(key), F.col("node").alias("_node"), F.col("component").alias("_component")).distinct()
    again = again.join(stays, [key, "_node"]).dropDuplicates(["_component"])
    return kept.unionByName(again.select(*masked.restored()))
