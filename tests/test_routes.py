"""Routes counted, components and sets of sources, against brute force."""

import random

from graphs import Builder
from pyspark.sql import functions as F

from trailmark import file_queries
from trailmark.operators import blast_radius, maintainers, routes, traverse

EDGE = "edge_id long, src long, dst long"


def random_graphs(seed=4):
    """Several graphs side by side, with cycles, loops and parallel edges."""
    rng, edges, seeds = random.Random(seed), [], []
    for g in range(4):
        nodes = range(100 * g + 1, 100 * g + 10)
        for _ in range(rng.randint(16, 26)):
            a, b = rng.choice(nodes), rng.choice(nodes)
            if g % 3 == 0 and a > b:
                a, b = b, a
            edges += [(len(edges) + 1, a, b)] * (1 if rng.random() < 0.8 else 2)
        seeds += [nodes[0], nodes[4]]
    edges = [(i + 1, a, b) for i, (_, a, b) in enumerate(edges)]
    return edges, [(i, n) for i, n in enumerate([*seeds, seeds[0]])]


def slow_paths(edges, seeds, hops):
    out = {}
    for _, seed in seeds:
        todo = [((seed,), ())]
        while todo:
            nodes, taken = todo.pop()
            if taken:
                out.setdefault((seed, nodes[-1]), []).append((len(taken), list(taken), list(nodes)))
            if len(taken) < hops:
                todo += [((*nodes, b), (*taken, e)) for e, a, b in edges if a == nodes[-1] and b not in nodes]
    return out


def test_counts_equal_listed_routes(spark):
    edges, seeds = random_graphs()
    e, s = spark.createDataFrame(edges, EDGE), spark.createDataFrame(seeds, "ordinal long, node long")
    want = slow_paths(edges, seeds, 5)
    counts = {}
    for (a, b), found in want.items():
        for h, _, _ in found:
            counts[a, b, h] = counts.get((a, b, h), 0) + 1
    got = routes.route_counts(e, s, 5).collect()
    assert {(r["source"], r["node"], r["hop"]): r["n"] for r in got} == counts
    assert len(got) == len(counts) > 60
    best = {(a, b): (min(found)[0], len(found), min(found)[2], min(found)[1]) for (a, b), found in want.items()}
    rows = blast_radius.reachable_by_counts(e, s, 5).collect()
    assert {(r["source"], r["node"]): (r["hop"], r["path_count"], r["nodes"], r["edges"]) for r in rows} == best
    listed = blast_radius.reachable(traverse.paths(e, s, 5)).collect()
    assert sorted(map(str, listed)) == sorted(map(str, rows))


def slow_knots(edges):
    ahead = {}
    for _, a, b in edges:
        ahead.setdefault(a, set()).add(b)

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for y in ahead.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    far = {x: reach(x) for _, a, b in edges for x in (a, b)}
    both = {x: {y for y in far[x] if x in far[y] and y != x} | {x} for x in far}
    return {x: max(c) for x, c in both.items() if len(c) > 1}


def test_knots(spark):
    edges, _ = random_graphs(11)
    edges += [(900 + i, 700 + i, 700 + (i + 1) % 9) for i in range(9)]  # one long cycle
    found = routes.knots(spark.createDataFrame(edges, EDGE))
    assert {r["node"]: r["knot"] for r in found.collect()} == slow_knots(edges)


def test_no_knots(spark):
    assert routes.knots(spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 3)], EDGE)) is None
    assert routes.knots(spark.createDataFrame([(1, 1, 2), (2, 3, 2), (3, 3, 1)], EDGE)) is None
    assert routes.knots(spark.createDataFrame([], EDGE)) is None


def test_very_many_routes(spark):
    """Sixteen layers of eight, each joined to all of the next: 2^45 routes
    to the last, and of twenty more layers than a long could hold.
    """
    width = 8
    edges = [(0, 1, width * 1 + j) for j in range(width)]
    edges += [(0, width * k + i, width * (k + 1) + j) for k in range(1, 16) for i in range(width) for j in range(width)]
    edges = [(i, a, b) for i, (_, a, b) in enumerate(edges)]
    rows = blast_radius.reachable_by_counts(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(0, 1)], "ordinal long, node long"), 16)
    last = rows.where(f"node >= {width * 16}").collect()
    assert len(last) == width and {r["path_count"] for r in last} == {width**15} and width**15 == 2**45
    assert all(len(r["edges"]) == 16 for r in last)
    many = [(i, a, b) for i, (_, a, b) in enumerate(edges * 12)]
    n = routes.route_counts(spark.createDataFrame(many, EDGE), spark.createDataFrame([(0, 1)], "ordinal long, node long"), 16)
    assert n.where("hop = 16").first()["n"] == routes.MOST and n.where("hop = 5").first()["n"] == 12**5 * width**4


def dense(spark, n):
    """``n`` versions that all depend on each other, and one bad one."""
    b = Builder(spark)
    bad = b.version("bad", "1.0.0")
    others = [b.version(f"v{i}", "1.0.0") for i in range(n)]
    for v in others:
        b.edge("resolves_to", v, bad)
        for w in others:
            if v != w:
                b.edge("resolves_to", v, w)
    b.edge("resolved", b.service("shop"), others[-1], 5)
    return b.build()


def limit_kinds(answer):
    return [x["kind"] for x in answer.first()["limits"]]


def test_a_dense_component_meets_its_budget(spark):
    graph = dense(spark, 7)
    bounds = blast_radius.Bounds(max_hops=7, path_count=10**9, paths_a_level=400)
    r = blast_radius.blast_radius(graph, "npm:bad:1.0.0", bounds)
    assert "budget_rejected" in limit_kinds(r.answer)
    whole = blast_radius.blast_radius(graph, "npm:bad:1.0.0", blast_radius.Bounds(max_hops=7, path_count=10**9))
    assert "budget_rejected" not in limit_kinds(whole.answer)
    # seven first steps, then any order of others: 1 + 6 + 30 + ... routes to each
    assert {v["path_count"] for v in whole.versions.collect()} == {1 + 6 + 30 + 120 + 360 + 720 + 720}


def test_path_count_keeps_the_first_routes(spark):
    graph = dense(spark, 5)
    source = graph.node("versions").where("name = 'bad'").select(F.lit(0).alias("ordinal"), F.col("id").alias("node"))
    edges = graph.edge("depended_on_by").select("edge_id", "src", "dst")
    for k in (6, 25, 10**6):
        found = blast_radius.bounded_reach(edges, source, blast_radius.Bounds(max_hops=4, path_count=k))
        want = traverse.paths(edges, source, 4, path_count=k)
        assert sorted(map(str, found.reached.collect())) == sorted(map(str, blast_radius.reachable(want).collect()))
        assert (found.n_paths, found.longest) == want.agg(F.count("*"), F.max("hop")).first()


def test_closure_has_no_end_but_its_own(spark):
    n = 20
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long")
    assert traverse.closure(chain, spark.createDataFrame([(n,)], "node long")).count() == n + 1


def test_sets_of_sources_equal_reach(spark):
    edges, _ = random_graphs(9)
    e = spark.createDataFrame(edges, EDGE)
    rng = random.Random(3)
    pairs = [(s, rng.choice(edges)[1]) for s in (*range(-70, 70, 3), 2**40, -(2**62)) for _ in range(2)]
    seeds = spark.createDataFrame(pairs, "source long, node long")
    sets = traverse.reach_sets(e, traverse.as_sets(seeds, "source", "node"), 5)
    want = {tuple(r) for r in traverse.reach(e, seeds, 5, include_seeds=True).select("source", "node", "hop").collect()}
    assert {tuple(r) for r in traverse.set_members(sets, "node", "hop").select("source", "node", "hop").collect()} == want
    n = {r["source"]: r["n"] for r in traverse.set_counts(sets).collect()}
    assert n == {s: sum(1 for x in want if x[0] == s) for s, _, _ in want}
    words = {(s >> 6) for s, _ in pairs}
    per_hop = sets.groupBy("hop").agg(F.count("*").alias("n"), F.count_distinct("node").alias("nodes")).collect()
    assert all(r["n"] <= r["nodes"] * len(words) for r in per_hop)


def test_counts_of_accounts_equal_their_lists(spark):
    rng = random.Random(8)
    b = Builder(spark)
    packages = [b.package(f"p{i}", i) for i in range(12)]
    versions = [b.version(f"p{i}", "1.0.0", script=i % 3 == 0) for i in range(12)]
    for v, p in zip(versions, packages, strict=True):
        b.edge("version_of", v, p)
    for i, v in enumerate(versions):
        for w in rng.sample(versions[:i], min(i, 2)):
            b.edge("resolves_to", v, w)
    people = [b.maintainer(f"m{i}") for i in range(70)]
    for m in people:
        for p in rng.sample(packages, rng.randint(1, 2)):
            b.edge("maintains", m, p)
    for i in range(9):
        s = b.service(f"s{i}")
        for v in rng.sample(versions, 2):
            b.edge("resolved", s, v, 7)
    graph = b.build()
    rights = maintainers.publish_rights(graph)
    reached = maintainers.account_reach(graph, maintainers.seed_versions(graph, rights), 8)
    listed = maintainers.service_reach(graph, reached).groupBy("maintainer").agg(F.count("*").alias("n"), F.min("hop").alias("near"))
    counted = maintainers.service_counts(graph, reached)
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, counted.collect()))
    pairs = traverse.set_members(reached, "node", "hop").withColumnRenamed("source", "maintainer").where("hop > 0")
    script = graph.node("versions").select(F.col("id").alias("node"), "has_install_script")
    of = graph.edge("version_of").select(F.col("src").alias("node"), F.col("dst").alias("package"))
    slow = pairs.join(script, "node").join(of, "node").join(rights.withColumn("own", F.lit(True)), ["maintainer", "package"], "left").groupBy("maintainer").agg(
        F.count_distinct(F.when(F.col("hop") == 1, F.col("node"))).alias("direct_dependents"), F.count_distinct(F.when((F.col("hop") == 1) & F.col("has_install_script"), F.col("node"))).alias("dependents_with_install_script"),
        F.count_distinct(F.when((F.col("hop") == 2) & F.col("own").isNull(), F.col("package"))).alias("modelled_candidates"),
    )
    fast = maintainers.dependents(graph, reached, rights).select(slow.columns)
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect())) and fast.count() > 30


def test_sets_side_by_side_are_the_same_sets(spark):
    rows = [(n, w, 1 << (n * 7 + w) % 63) for n in range(5) for w in (*range(-40, 40, 3), 2**34, -(2**50))]
    sets = spark.createDataFrame(rows, "node long, word long, bits long")
    wide = traverse.widened(sets.unionByName(sets.withColumn("bits", F.lit(1).cast("long"))), "node")
    assert {tuple(r) for r in traverse.narrowed(wide, "node").collect()} == {(n, w, b | 1) for n, w, b in rows}
    assert wide.count() * 3 < len(rows)


def test_services_are_listed_without_a_sort_of_all_pairs(spark, sf):
    plan = file_queries.q32_services_of_accounts(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [" not in plan
