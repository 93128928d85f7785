"""Bounded walks: all simple paths, least distances, and sets of sources.

``paths`` lists routes and grows with their number; ``reach`` only finds who
can be reached and stays linear in the edges for each source; ``reach_sets``
walks from many sources at once, 64 to a number.  All are loops of joins, one
per hop; with ``checkpoint`` each hop is cut off and an empty one ends the
loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, settled, stored

MAX_HOPS = 16
PATHS = "source long, ordinal long, hop int, tail long, nodes array<long>, edges array<long>"


def steps(edges: DataFrame, in_place: bool) -> DataFrame:
    """``(_at, _to)``: one hop.  A table that is bucketed by ``src`` is read
    where it lies at each hop, so only the walk's own rows are shuffled; other
    edges are made distinct and written once.
    """
    narrow = edges.select(F.col("src").alias("_at"), F.col("dst").alias("_to"))
    return narrow if in_place else stored(narrow.distinct(), "steps")[0]


def check_bounds(max_hops: int, path_count: int | None = None) -> None:
    if not 1 <= max_hops <= MAX_HOPS:
        raise ValueError(f"max_hops must be from 1 to {MAX_HOPS}, not {max_hops}")
    if path_count is not None and path_count < 1:
        raise ValueError(f"path_count must be 1 or more, not {path_count}")


class BudgetError(RuntimeError):
    """A level has more paths or rows than allowed; ``hop`` is the last one
    that fits, and ``found`` what was found up to it, if that is kept.
    """

    def __init__(self, hop: int, most: int, of: str = "paths", found: DataFrame | None = None) -> None:
        super().__init__(f"more than {most} {of} of {hop + 1} hops")
        self.hop, self.found = hop, found


def paths(edges: DataFrame, seeds: DataFrame, max_hops: int, path_count: int | None = None, targets: DataFrame | None = None, checkpoint: bool = False, most: int | None = None) -> DataFrame:
    """Simple paths (``PATHS``) along ``edges (edge_id, src, dst)`` from
    ``seeds (ordinal, node)``.

    No node repeats within a path; parallel edges make different paths, and a
    seed given twice gives its paths twice.  Each prefix of one hop or more is
    a path of its own where its tail is in ``targets (id)``, or always without
    them; other tails are walked on from.  Order is (hop, ordinal, edges), and
    ``path_count`` keeps the first so many.  With ``checkpoint`` a level of
    over ``most`` paths raises BudgetError.
    """
    check_bounds(max_hops, path_count)
    step = edges.select("edge_id", F.col("src").alias("_at"), F.col("dst").alias("_to"))
    now = seeds.select(F.col("node").alias("source"), F.col("ordinal").cast("long").alias("ordinal"), F.lit(0).alias("hop"), F.col("node").alias("tail"), F.array("node").alias("nodes"), F.array().cast("array<bigint>").alias("edges"))
    levels: list[DataFrame] = []
    held = 0
    for hop in range(1, max_hops + 1):
        now = now.join(step, now["tail"] == step["_at"]).where(~F.array_contains("nodes", F.col("_to"))).select(
            "source", "ordinal", F.lit(hop).alias("hop"), F.col("_to").alias("tail"), F.concat("nodes", F.array("_to")).alias("nodes"), F.concat("edges", F.array("edge_id")).alias("edges")
        )
        if checkpoint:
            now, n = stored(now, "paths")
            if not n:
                break
            if most is not None and n > most:
                raise BudgetError(hop - 1, most)
        levels.append(now if targets is None else now.join(targets.select(F.col("id").alias("tail")).distinct(), "tail", "left_semi").select(*now.columns))
        if checkpoint and path_count is not None:
            held += levels[-1].count()
            if held >= path_count:
                break
    if not levels:
        return seeds.sparkSession.createDataFrame([], PATHS)
    found = reduce(DataFrame.unionByName, levels)
    return found if path_count is None else found.orderBy("hop", "ordinal", "edges").limit(path_count)


def reach(edges: DataFrame, seeds: DataFrame, max_hops: int, include_seeds: bool = False, most: int | None = None, in_place: bool = False) -> DataFrame:
    """``(source, node, hop)``: the least number of hops to each node.

    ``seeds (source, node)`` may give a source several nodes, at hop 0.  Every
    hop is written once, which also counts it, and an empty one ends the walk;
    one of over ``most`` rows raises BudgetError with the hops before.  With
    ``in_place`` the edges are read as they are, see ``steps``.
    """
    check_bounds(max_hops)
    step = steps(edges, in_place)
    front, n = stored(seeds.select("source", "node", F.lit(0).alias("hop")).distinct(), "reach")
    seen = front
    for hop in range(1, max_hops + 1):
        if not n:
            break
        grown = front.join(step, front["node"] == step["_at"]).select("source", F.col("_to").alias("node")).distinct()
        front, n = stored(grown.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("hop", F.lit(hop)), "reach")
        if most is not None and n > most:
            raise BudgetError(hop - 1, most, "rows", seen if include_seeds else seen.where("hop > 0"))
        seen = seen.unionByName(front)
    return seen if include_seeds else seen.where("hop > 0")


def as_sets(pairs: DataFrame, source: str, *by: str) -> DataFrame:
    """``(*by, word, bits)``: the sources of each key, 64 to a number.

    Source ``s`` is bit ``s % 64`` of word ``s div 64``, so any ids will do;
    the closer together they are, the fuller the words.
    """
    bit = F.expr(f"shiftleft(1L, CAST(`{source}` & 63 AS INT))")
    return pairs.groupBy(*by, F.shiftright(source, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def reach_sets(edges: DataFrame, members: DataFrame, max_hops: int, most: int | None = None, in_place: bool = False) -> DataFrame:
    """``(node, word, hop, bits)``: the sources that first reach a node at a hop.

    ``members (node, word, bits)`` are those at hop 0, as by ``as_sets``.  A
    hop has at most one row for each node and word of sources, and a source is
    in one row of a node.  A hop of over ``most`` rows raises BudgetError with
    the hops before.
    """
    try:
        levels = reach_wide(edges, members, max_hops, most, in_place)
    except BudgetError as e:
        e.found = narrowed(e.found, "node", "hop")
        raise
    return narrowed(levels, "node", "hop").select("node", "word", "hop", "bits")


def reach_wide(edges: DataFrame, members: DataFrame, max_hops: int, most: int | None = None, in_place: bool = False) -> DataFrame:
    """``reach_sets`` with sixteen words to a row: ``(node, block, b0..b15, hop)``.

    A hop is two jobs whose shuffles are deleted when they are done, so the
    disk holds the hops and what one job shuffles.
    """
    check_bounds(max_hops)
    step, n_steps = edges.select(F.col("src").alias("node"), F.col("dst").alias("_to")), 0
    if not in_place:
        step, n_steps = settled(step.distinct(), "steps")
    front, n = settled(widened(members, "node").withColumn("hop", F.lit(0)), "sets")
    levels = front
    for hop in range(1, max_hops + 1):
        if not n:
            break
        grown = joined_sets(beside(front.drop("hop"), step, "node", n_steps).drop("node").withColumnRenamed("_to", "node"), "node")
        if n_steps > ROWS_BESIDE:
            grown, _ = settled(grown, "grown")
        known = joined_sets(levels, "node").select("node", "block", *[F.col(c).alias(f"_{c}") for c in LANES])
        fresh = [F.col(c).bitwiseAND(F.bitwise_not(F.coalesce(f"_{c}", F.lit(0).cast("long")))).alias(c) for c in LANES]
        rows = grown.join(known, ["node", "block"], "left").select("node", "block", *fresh, F.lit(hop).alias("hop"))
        front, n = settled(rows.where(reduce(lambda x, y: x | y, [F.col(c) != 0 for c in LANES])), "sets")
        if n_steps > ROWS_BESIDE:
            dropped(grown)
        if most is not None and n and narrowed(front, "node").count() > most:
            raise BudgetError(hop - 1, most, "rows", levels)
        levels = levels.unionByName(front)
    if not in_place:
        dropped(step)
    return levels


#: Joins of so many rows deal nodes out by groups of 4,096 ids next to each
#: other: what one task joins then meets more often in the sums before the next
#: shuffle.  Ids that lie far apart are groups of their own.
ROWS_BESIDE, GROUP = 1_000_000, 12


def beside(wide: DataFrame, rows: DataFrame, key: str, n: int) -> DataFrame:
    """``wide`` joined with ``n`` ``rows`` on ``key``."""
    if n <= ROWS_BESIDE:
        return wide.join(rows, key)
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_BESIDE))  # of fewer a join would deal anew
    dealt = [x.withColumn("_group", F.shiftright(key, GROUP)).repartition(tasks, "_group") for x in (wide, rows)]
    return dealt[0].join(dealt[1], ["_group", key]).drop("_group")


#: Words that lie side by side in a row while sets are joined: a row's own
#: weight is shared by 1,024 sources, so less is shuffled and written.
LANES = [f"b{i}" for i in range(16)]


def widened(sets: DataFrame, *by: str) -> DataFrame:
    """``(*by, block, b0..b15)`` of ``sets (*by, word, bits)``, folded."""
    lane = lambda i: F.coalesce(F.bit_or(F.when(F.col("word").bitwiseAND(F.lit(15).cast("long")) == i, F.col("bits"))), F.lit(0).cast("long"))
    return sets.groupBy(*by, F.shiftright("word", 4).alias("block")).agg(*[lane(i).alias(c) for i, c in enumerate(LANES)])


def joined_sets(wide: DataFrame, *by: str) -> DataFrame:
    """The union of the sets of each key."""
    return wide.groupBy(*by, "block").agg(*[F.bit_or(c).alias(c) for c in LANES])


def narrowed(wide: DataFrame, *keep: str) -> DataFrame:
    """``(*keep, word, bits)`` again, without empty words."""
    words = F.array(*[F.struct(F.expr(f"shiftleft(block, 4) + {i}").alias("word"), F.col(c).alias("bits")) for i, c in enumerate(LANES)])
    return wide.select(*keep, F.inline(words)).where("bits <> 0")


def set_counts(sets: DataFrame) -> DataFrame:
    """``(source, n)``: in how many rows of ``sets (word, bits)`` each source
    is, by 64 sums for a word, so rows aren't multiplied.
    """
    sums = F.array(*[F.sum(F.shiftright("bits", j).bitwiseAND(F.lit(1).cast("long"))) for j in range(64)])
    places = sets.groupBy("word").agg(sums.alias("n")).select("word", F.posexplode("n").alias("bit", "n")).where("n > 0")
    return places.select(F.expr("shiftleft(word, 6) + bit").alias("source"), "n")


def set_members(sets: DataFrame, *keep: str) -> DataFrame:
    """``(*keep, source)``: a row for each source of each row of ``sets``."""
    places = F.explode(F.expr("filter(sequence(0, 63), j -> shiftright(bits, j) & 1L = 1L)")).alias("_bit")
    return sets.select(*keep, "word", places).select(*keep, F.expr("shiftleft(word, 6) + _bit").alias("source"))


def closure(edges: DataFrame, marked: DataFrame) -> DataFrame:
    """``(node)``: the marked nodes and all that lead to them, cycles included.

    Edges are followed from dst to src until no new node appears, however many
    rounds that takes; each round touches only the newest ones.
    """
    back, _ = stored(edges.select(F.col("dst").alias("node"), F.col("src").alias("_to")).distinct(), "back")
    front, n = stored(marked.select("node").distinct(), "closure")
    seen, rounds = front, 0
    while n:
        front, n = stored(front.join(back, "node").select(F.col("_to").alias("node")).distinct().join(seen, "node", "left_anti"), "closure")
        seen, rounds = seen.unionByName(front), rounds + 1
        if rounds % 16 == 0:
            seen, _ = stored(seen, "closure")
    return seen


def path_count_limit_reached(n: int, path_count: int) -> bool:
    """A full result may have been cut."""
    return n >= path_count
