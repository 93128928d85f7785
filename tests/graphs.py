"""Small graphs with known answers."""

from trailmark.operators.graph import COVERAGE, NODES, Graph, edge_schema

PUBLISHED, PINNED = 1542844800000, 1542931200000


class Builder:
    """Adds nodes and edges with ids in order of insertion."""

    def __init__(self, spark):
        self.spark, self.rows, self.rels, self.claims, self.ids = spark, {k: [] for k in NODES}, {}, [], {}

    def _node(self, label, key, *values):
        self.ids[key] = len(self.ids) + 1
        self.rows[label].append((self.ids[key], key, *values))
        return key

    def version(self, name, version, published=PUBLISHED, script=False):
        return self._node("versions", f"npm:{name}:{version}", "npm", name, version, published, script)

    def package(self, name, downloads=None):
        return self._node("packages", f"npm:{name}", "npm", name, downloads)

    def service(self, name):
        return self._node("services", f"svc:{name}", name, "seed")

    def maintainer(self, name):
        return self._node("maintainers", f"npm:{name}", "npm", name)

    def advisory(self, ghsa, published):
        return self._node("advisories", ghsa, ghsa, published, published, "")

    def edge(self, rel, a, b, *values):
        rows = self.rels.setdefault(rel, [])
        rows.append((len(rows) + 1, self.ids[a], self.ids[b], *values))

    def claim(self, key, level, kind="package"):
        self.claims.append((kind, key, level))

    def build(self):
        nodes = {k: self.spark.createDataFrame(v, NODES[k]) for k, v in self.rows.items()}
        edges = {k: self.spark.createDataFrame(v, edge_schema(k)) for k, v in self.rels.items()}
        return Graph(self.spark, nodes, edges, self.spark.createDataFrame(self.claims, COVERAGE))


def chain(spark, level=2, extra=()):
    """flatmap-stream <- event-stream <- ps-tree <- nodemon, and chalk apart."""
    b = Builder(spark)
    flat = b.version("flatmap-stream", "0.1.1", script=True)
    event, tree, nodemon, chalk = b.version("event-stream", "3.3.6"), b.version("ps-tree", "1.2.0"), b.version("nodemon", "1.18.7"), b.version("chalk", "5.3.1")
    for a, c in ((event, flat), (tree, event), (nodemon, tree), *extra):
        b.edge("resolves_to", a, c)
    for name, pin in (("checkout-api", event), ("wallet-web", nodemon), ("docs-site", chalk)):
        b.edge("resolved", b.service(name), pin, PINNED)
    for name in ("flatmap-stream", "event-stream", "ps-tree", "nodemon", "chalk"):
        if level is not None:
            b.claim(f"npm:{name}", level)
    return b
