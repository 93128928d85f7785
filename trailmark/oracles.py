"""The queries of ``queries`` in DuckDB SQL, written against the raw tables."""

from __future__ import annotations

PINS = """pins AS (SELECT DISTINCT o_custkey AS src, l_partkey AS dst, epoch_ms(o_orderdate) AS ms
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
DEPS = """deps AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a
  JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_partkey < b.l_partkey)"""
FACTS = """facts AS (SELECT l_partkey AS id, min(epoch_ms(o_orderdate)) AS pub, min(CASE WHEN l_returnflag = 'R' THEN epoch_ms(l_shipdate) END) AS dis, count(*) AS lines
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey)"""
MAIN = """main AS (SELECT dst, src FROM (SELECT l_partkey AS dst, l_suppkey AS src, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_suppkey) AS r
  FROM lineitem GROUP BY 1, 2) WHERE r = 1)"""
SEEDS = """seeds AS (SELECT dst AS node, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, dst) - 1 AS ordinal FROM deps GROUP BY dst ORDER BY n DESC, dst LIMIT 5)"""


def walk(hops: int, limit: int = 5) -> str:
    """Simple paths backwards along dependencies from the seeds."""
    return f"""walk AS (SELECT node AS source, ordinal, 0 AS hop, node AS tail, [node] AS nodes, CAST([] AS BIGINT[]) AS edges FROM seeds WHERE ordinal < {limit}
  UNION ALL SELECT w.source, w.ordinal, w.hop + 1, d.src, list_append(w.nodes, d.src), list_append(w.edges, d.src * 10000000 + d.dst)
  FROM walk w JOIN deps d ON d.dst = w.tail WHERE w.hop < {hops} AND NOT list_contains(w.nodes, d.src))"""


def names(separator: str, brand: bool = True) -> str:
    name = f"replace(p_name, ' ', '{separator}')" + (f" || '{separator}' || substr(p_brand, 7, 9)" if brand else "")
    return f"""(SELECT {name} AS name, sum(coalesce(n, 0)) AS dl FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey GROUP BY 1)"""


def flat(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def canonical(x: str) -> str:
    return f"translate(replace(replace(lower({x}), 'rn', 'm'), 'vv', 'w'), '1i05', 'llos')"


EXPOSED = f"""WITH RECURSIVE {DEPS}, {SEEDS}, {PINS}, {walk(8)},
reach AS (SELECT source, tail AS node, min(hop) AS hop, count(*) AS n FROM walk GROUP BY ALL),
hit AS (SELECT r.source, p.src AS service, r.hop, r.n, p.ms, row_number() OVER (PARTITION BY r.source, p.src ORDER BY r.hop, p.ms, p.src * 10000000 + p.dst) AS rk, p.dst FROM pins p JOIN reach r ON p.dst = r.node),
exposed AS (SELECT source, service, min(hop) + 1 AS hop, min(hop) = 0 AS is_direct, sum(n)::BIGINT AS path_count, max(CASE WHEN rk = 1 THEN ms END) AS resolved_at_ms FROM hit GROUP BY ALL)"""

FRAMES = f"""WITH RECURSIVE {DEPS}, {SEEDS}, {PINS}, {walk(8, 1)},
reach AS (SELECT source, tail AS node, min(hop) AS hop FROM walk GROUP BY ALL),
hit AS (SELECT p.src AS service, p.ms, row_number() OVER (PARTITION BY p.src ORDER BY r.hop, p.ms, p.src * 10000000 + p.dst) AS rk FROM pins p JOIN reach r ON p.dst = r.node),
exposed AS (SELECT service, ms, ms >= 852076800000 AND ms < 883612800000 AS blind FROM hit WHERE rk = 1),
inst AS (SELECT DISTINCT at_ms FROM (SELECT unnest(range(820454400000, 946684800001, 2592000000)) AS at_ms UNION ALL SELECT 946684800000 UNION ALL SELECT 883612800000)),
num AS (SELECT at_ms, CAST(row_number() OVER (ORDER BY at_ms) - 1 AS INTEGER) AS frame FROM inst),
cum AS (SELECT frame, at_ms, count(e.service) AS exposed, count(CASE WHEN blind THEN 1 END) AS blind_spots FROM num LEFT JOIN exposed e ON e.ms <= at_ms GROUP BY ALL),
frames AS (SELECT frame, at_ms, exposed, exposed - coalesce(lag(exposed) OVER (ORDER BY frame), 0) AS newly_exposed, blind_spots, at_ms >= 883612800000 AS advisory_public,
  greatest((SELECT count(*) FROM customer) - exposed, 0) AS not_seen_exposed FROM cum)"""

LEVEL = "CASE p_size % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END"

LOCK = """dep AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS path, l_partkey, 'part-' || l_partkey AS name, CASE WHEN l_quantity > 40 THEN p_size || '.9.9' ELSE p_size || '.0.0' END AS version, p_size
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
SCAN = f"""WITH {FACTS}, {LOCK},
m AS (SELECT dep.*, CASE WHEN dis IS NULL THEN 'none' WHEN version = p_size || '.0.0' THEN 'exact' ELSE 'package' END AS match FROM dep LEFT JOIN facts ON l_partkey = id),
scanned AS (SELECT path, name, version, match, CASE WHEN p_size % 3 = 2 THEN 'unknown' WHEN match = 'exact' THEN 'exposed' WHEN match = 'package' OR p_size % 3 = 1 THEN 'unknown' ELSE 'not_exposed' END AS verdict,
  CASE WHEN match = 'none' THEN 0 ELSE 1 END AS n_advisories FROM m)"""

SURFACES = f"""WITH RECURSIVE {FACTS}, {MAIN}, {DEPS}, {PINS},
own AS (SELECT m.src AS s, count(*) AS packages, sum(coalesce(lines, 0))::BIGINT AS weekly_downloads, count(CASE WHEN lines IS NULL THEN 1 END) AS without, min({LEVEL}) AS level
  FROM main m JOIN part ON p_partkey = m.dst LEFT JOIN facts ON id = m.dst GROUP BY 1),
steps AS (SELECT src AS s, dst AS node, 0 AS hop FROM main UNION SELECT r.s, d.src, r.hop + 1 FROM steps r JOIN deps d ON d.dst = r.node WHERE r.hop < 8),
reach AS (SELECT s, node, min(hop) AS hop FROM steps GROUP BY ALL),
svc_hops AS (SELECT s, p.src AS c, min(hop) + 1 AS hop FROM reach JOIN pins p ON p.dst = node GROUP BY ALL),
svc AS (SELECT s, count(*) AS services, min(hop) AS near FROM svc_hops GROUP BY s),
dep AS (SELECT s, count(DISTINCT node) AS direct, count(DISTINCT CASE WHEN p_size > 40 THEN node END) AS scripts FROM reach JOIN part ON p_partkey = node WHERE hop = 1 GROUP BY s),
board AS (SELECT 'npm:' || s_name AS maintainer_key, packages, coalesce(services, 0) AS services, near AS nearest_service_hop, coalesce(direct, 0) AS direct_dependents, coalesce(scripts, 0) AS dependents_with_install_script,
  weekly_downloads, without AS packages_without_downloads, CASE WHEN without = 0 THEN 'known' WHEN without = packages THEN 'unknown' ELSE 'partial' END AS downloads_basis,
  CASE WHEN coalesce(services, 0) > 0 THEN 'exposed' WHEN level < 2 THEN 'unknown' ELSE 'not_exposed' END AS verdict,
  CASE WHEN coalesce(services, 0) > 0 AND level < 2 THEN 'A path exists; the search was cut short, so there may be more.' WHEN coalesce(services, 0) > 0 THEN 'A path exists, and the search was complete.'
    WHEN level < 2 THEN 'No path was seen, but the search was cut short: npm:' || s_name || ' is loaded in part.' ELSE 'No path exists; all that npm:' || s_name || ' needs is loaded and the search was complete.' END
    || ' Only loaded packages and services are counted, so the real surface is this large at least.' AS rationale
  FROM own JOIN supplier ON s_suppkey = own.s LEFT JOIN svc ON svc.s = own.s LEFT JOIN dep ON dep.s = own.s)"""

READINGS = """first AS (SELECT 'npm:part-' || p_partkey AS key, p_partkey AS id, p_name AS name, CASE WHEN p_size > 5 THEN p_size END AS size, CASE WHEN p_type = 'ECONOMY' THEN p_brand END AS brand FROM part WHERE p_size <= 30),
second AS (SELECT 'npm:part-' || p_partkey AS key, p_partkey AS id, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS name, p_size AS size, p_brand AS brand FROM part WHERE p_size >= 20)"""

PART_VERSION = "p_size || '.' || (p_partkey % 10) || '.' || (p_partkey % 3)"

ORACLES = {
    "q01_counts": f"""WITH {FACTS}, {DEPS}, {PINS}
SELECT 'node' AS kind, 'packages' AS name, count(*) AS n FROM part UNION ALL SELECT 'node', 'versions', count(*) FROM part UNION ALL SELECT 'node', 'maintainers', count(*) FROM supplier
UNION ALL SELECT 'node', 'services', count(*) FROM customer UNION ALL SELECT 'node', 'advisories', count(dis) FROM facts
UNION ALL SELECT 'edge', 'version_of', count(*) FROM part UNION ALL SELECT 'edge', 'depends_on', 0 UNION ALL SELECT 'edge', 'typosquat_of', 0
UNION ALL SELECT 'edge', 'resolves_to', count(*) FROM deps UNION ALL SELECT 'edge', 'depended_on_by', count(*) FROM deps
UNION ALL SELECT 'edge', 'maintains', count(DISTINCT l_partkey) FROM lineitem UNION ALL SELECT 'edge', 'resolved', count(*) FROM pins
UNION ALL SELECT 'edge', 'affects', count(dis) FROM facts JOIN part ON id = p_partkey UNION ALL SELECT 'edge', 'affects_version', count(dis) FROM facts JOIN part ON id = p_partkey""",
    "q01_slice_counts": f"""WITH {FACTS}, {DEPS}, {PINS} SELECT (SELECT count(*) FROM part) AS packages, (SELECT count(*) FROM part) AS versions, (SELECT count(*) FROM supplier) AS maintainers,
(SELECT count(*) FROM customer) AS services, (SELECT count(dis) FROM facts) AS advisories, (SELECT count(*) FROM deps) + (SELECT count(*) FROM pins) AS resolution_edges""",
    "q02_read_nodes": f"WITH {FACTS} SELECT p_partkey AS id, 'npm:part-' || p_partkey AS key, lines AS weekly_downloads FROM part JOIN facts ON id = p_partkey",
    "q02_list_nodes": "SELECT c_custkey AS id FROM customer ORDER BY c_custkey LIMIT 100",
    "q03_neighbours": f"""WITH {DEPS}, hops AS (SELECT src AS id, 0 AS side, dst AS neighbour, src * 10000000 + dst AS edge_id FROM deps UNION ALL SELECT dst, 1, src, src * 10000000 + dst FROM deps)
SELECT id, CAST(rank AS INTEGER) AS rank, neighbour, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY side, edge_id) AS rank FROM hops WHERE id IN (SELECT p_partkey FROM part)) WHERE rank <= 8""",
    "q03_pins_in_window": f"""WITH {PINS} SELECT dst AS id, CAST(rank AS INTEGER) AS rank, src AS neighbour, ms AS resolved_at_ms
FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src, ms) AS rank FROM pins WHERE ms >= 852076800000 AND ms < 883612800000 AND dst IN (SELECT p_partkey FROM part)) WHERE rank <= 20""",
    "q04_paths": f"""WITH RECURSIVE {DEPS}, {SEEDS}, {walk(8)}
SELECT source, tail, hop, count(*) AS n_paths, min(array_to_string(nodes, '>')) AS least_path FROM walk WHERE hop > 0 GROUP BY source, tail, hop""",
    "q04_first_paths": f"""WITH RECURSIVE {DEPS}, {SEEDS}, {walk(8)} SELECT ordinal, hop, tail, array_to_string(nodes, '>') AS path FROM walk WHERE hop > 0 ORDER BY hop, ordinal, edges LIMIT 200""",
    "q05_reach": f"WITH RECURSIVE {DEPS}, {SEEDS}, {walk(8)} SELECT source, tail AS node, min(hop) AS hop FROM walk WHERE hop > 0 GROUP BY source, tail",
    "q05_version_exposures": f"""WITH RECURSIVE {DEPS}, {SEEDS}, {walk(8)} SELECT source, tail AS node, min(hop) AS hop, count(*) AS path_count, arg_min(array_to_string(nodes, '>'), {{'h': hop, 'e': edges}}) AS route
FROM walk WHERE hop > 0 GROUP BY source, tail""",
    "q05_service_exposures": f"{EXPOSED} SELECT * FROM exposed",
    "q06_resolved_while_live": f"""WITH {PINS}, {FACTS} SELECT dst AS version, src AS service, min(ms) AS resolved_at_ms, min(dis) - min(ms) AS ms_before_disclosure
FROM pins JOIN facts ON id = dst WHERE ms >= pub AND ms < dis GROUP BY dst, src""",
    "q06_answers": f"""WITH {PINS}, {FACTS}, v AS (SELECT dst, count(DISTINCT src) AS n, min(ms) AS first_ms FROM pins JOIN facts ON id = dst WHERE ms >= pub AND ms < dis GROUP BY dst)
SELECT 'GHSA-' || id AS advisory_key, greatest(dis - pub, 0) AS window_ms, coalesce(n, 0) AS n_victims, first_ms AS first_pin_ms,
CASE WHEN dis <= pub THEN 'not_exposed' WHEN p_size % 3 = 2 THEN 'unknown' WHEN n > 0 THEN 'exposed' WHEN p_size % 3 = 1 THEN 'unknown' ELSE 'not_exposed' END AS verdict
FROM facts JOIN part ON id = p_partkey LEFT JOIN v ON dst = id WHERE dis IS NOT NULL""",
    "q07_timeline": f"""WITH {PINS}, {FACTS}, w AS (SELECT * FROM facts WHERE dis IS NOT NULL)
SELECT id AS version, pub AS at_ms, 'published' AS kind, CAST(NULL AS BIGINT) AS service, 0 AS kind_rank FROM w UNION ALL SELECT id, dis, 'disclosed', NULL, 2 FROM w
UNION ALL SELECT dst, min(ms), 'resolved', src, 1 FROM pins JOIN w ON id = dst WHERE ms >= pub AND ms < dis GROUP BY dst, src""",
    "q08_as_of": f"""{EXPOSED} SELECT source, CASE WHEN resolved_at_ms <= 883612800000 THEN 'kept' ELSE 'later' END AS bucket, count(*) AS services, min(hop) AS nearest FROM exposed GROUP BY ALL""",
    "q09_introduced": f"""WITH {FACTS} SELECT 'GHSA-' || id AS advisory_key, 'npm:part-' || id AS package_key, 'npm:part-' || id || ':' || p_size || '.0.0' AS introduced_key, p_size || '.0.0' AS stated_introduced,
CAST(1 AS BIGINT) AS n_versions, CAST(0 AS BIGINT) AS n_undecidable, CASE WHEN p_size % 3 = 2 THEN 'unknown' ELSE 'exposed' END AS verdict FROM facts JOIN part ON id = p_partkey WHERE dis IS NOT NULL""",
    "q09_rationales": f"""WITH {FACTS} SELECT 'GHSA-' || id AS advisory_key, p_size || '.0.0' AS introduced_version, CAST(NULL AS VARCHAR) AS stated_fixed, 'First affected is ' || p_size || '.0.0, no fix stated. ' ||
CASE p_size % 3 WHEN 0 THEN 'A path exists, and the search was complete.' WHEN 1 THEN 'A path exists; the search was cut short, so there may be more.' ELSE 'npm:part-' || id || ' was never loaded, so nothing is known about it.' END AS rationale
FROM facts JOIN part ON id = p_partkey WHERE dis IS NOT NULL""",
    "q09_affected_order": f"""WITH {FACTS}, v AS (SELECT p_name AS package_key, 'npm:' || p_name || ':' || p_size || '.' || (p_partkey % 7) || '.0' || ':' || p_partkey AS version_key, CASE WHEN p_size > 25 THEN pub END AS p, p_size, p_partkey % 7 AS minor FROM part LEFT JOIN facts ON id = p_partkey)
SELECT package_key, version_key, CAST(row_number() OVER (PARTITION BY package_key ORDER BY p NULLS LAST, p_size, minor, version_key) AS INTEGER) AS rank FROM v""",
    "q10_affected_versions": f"""WITH v AS (SELECT p_partkey, {PART_VERSION} AS version, [p_size, p_partkey % 10, p_partkey % 3] AS k, CAST(substr(p_brand, 7, 9) AS INTEGER) AS b FROM part)
SELECT p_partkey, version, CASE WHEN k >= [b, 5, 0] AND k < [b + 10, 2, 1] THEN 'affected' ELSE 'unaffected' END AS bucket FROM v""",
    "q10_earliest_affected": f"SELECT p_brand AS package_key, arg_min({PART_VERSION}, [p_size, p_partkey % 10, p_partkey % 3]) AS earliest FROM part GROUP BY p_brand",
    "q11_publish_rights": f"WITH {MAIN} SELECT src AS maintainer, dst AS package FROM main",
    "q11_leaderboard": f"{SURFACES} SELECT * FROM board",
    "q11_top_accounts": f"""{SURFACES} SELECT CAST(row_number() OVER (ORDER BY services DESC, weekly_downloads DESC, maintainer_key) AS INTEGER) AS rank, maintainer_key, services FROM board
ORDER BY services DESC, weekly_downloads DESC, maintainer_key LIMIT 10""",
    "q11_candidates": f"""WITH {MAIN}, {DEPS}, r1 AS (SELECT DISTINCT m.src AS s, d.src AS node FROM main m JOIN deps d ON d.dst = m.dst ANTI JOIN main o ON o.src = m.src AND o.dst = d.src),
r2 AS (SELECT DISTINCT r1.s, d.src AS node FROM r1 JOIN deps d ON d.dst = r1.node ANTI JOIN main o ON o.src = r1.s AND o.dst = d.src ANTI JOIN r1 q ON q.s = r1.s AND q.node = d.src),
a AS (SELECT s, node, 1 AS hop FROM r1 UNION ALL SELECT s, node, 2 FROM r2)
SELECT s AS maintainer, count(DISTINCT CASE WHEN hop = 1 THEN node END) AS direct_dependents, count(DISTINCT CASE WHEN hop = 1 AND p_size > 40 THEN node END) AS dependents_with_install_script,
count(DISTINCT CASE WHEN hop = 2 THEN node END) AS modelled_candidates FROM a JOIN part ON p_partkey = node GROUP BY s""",
    "q11_unranked": f"WITH {MAIN} SELECT 'npm:' || s_name AS maintainer_key FROM supplier WHERE s_suppkey NOT IN (SELECT src FROM main WHERE dst % 23 = 0)",
    "q12_verdicts": f"""WITH {FACTS} SELECT 'npm:part-' || p_partkey AS key,
CASE WHEN p_size % 3 = 2 THEN 'unknown' WHEN dis IS NOT NULL THEN 'exposed' WHEN coalesce(lines, 0) > 35 OR p_size % 3 = 1 THEN 'unknown' ELSE 'not_exposed' END AS verdict,
concat_ws(',', CASE WHEN p_size % 3 = 2 THEN 'package_absent' END, CASE WHEN coalesce(lines, 0) > 35 THEN 'path_limit' END, CASE WHEN p_size % 3 = 1 THEN 'package_partial' END) AS limit_kinds
FROM part LEFT JOIN facts ON id = p_partkey""",
    "q12_weakest_coverage": f"WITH {MAIN} SELECT src, min({LEVEL}) AS level, count(*) AS n FROM main JOIN part ON p_partkey = dst GROUP BY src UNION ALL SELECT -1, min({LEVEL}), count(*) FROM part WHERE p_size % 3 < 2",
    "q13_frames": f"{FRAMES} SELECT * FROM frames",
    "q13_bars": f"{FRAMES} SELECT frame, round(CASE WHEN max(exposed) OVER () > 0 THEN exposed / max(exposed) OVER () ELSE 0.0 END, 6) AS height, advisory_public FROM frames",
    "q14_frame_as_of": f"{FRAMES} SELECT frame, at_ms, exposed FROM frames WHERE frame = (SELECT coalesce(max(frame), 0) FROM frames WHERE at_ms <= 900000000000)",
    "q15_edit_distance": f"""SELECT s.name AS suspect, t.name AS target, CAST(damerau_levenshtein(s.name, t.name) AS INTEGER) AS distance, CAST(levenshtein(s.name, t.name) AS INTEGER) AS plain
FROM {names("-")} s, {names("-")} t WHERE s.name <> t.name AND abs(length(s.name) - length(t.name)) <= 1 AND damerau_levenshtein(s.name, t.name) <= 1""",
    "q15_levenshtein": f"""SELECT s.name AS suspect, t.name AS target, CAST(levenshtein(s.name, t.name) AS INTEGER) AS plain FROM {names("-", False)} s, {names("-", False)} t WHERE s.name <> t.name AND levenshtein(s.name, t.name) <= 2""",
    "q15_homoglyphs": f"""WITH s AS (SELECT name FROM {names("-")}), t AS (SELECT DISTINCT translate(name, 'i', '1') AS name FROM s)
SELECT s.name AS suspect, t.name AS target, {canonical("s.name")} AS form FROM s JOIN t ON {canonical("s.name")} = {canonical("t.name")} AND lower(s.name) <> lower(t.name)""",
    "q15_separators": f"""WITH s AS (SELECT name FROM {names("-")}), t AS (SELECT name FROM {names("_")})
SELECT s.name AS suspect, t.name AS target, {flat("s.name")} AS form, regexp_replace(s.name, '[^A-Za-z0-9]', '', 'g') <> regexp_replace(t.name, '[^A-Za-z0-9]', '', 'g') AS case_differs, lower(s.name) <> lower(t.name) AS separators_differ
FROM s JOIN t ON {flat("s.name")} = {flat("t.name")} AND s.name <> t.name""",
    "q15_padding": f"""WITH s AS (SELECT name FROM {names("-")}), t AS (SELECT name FROM {names("-", False)}), x AS (SELECT name, split_part(name, '-', 1) AS a, split_part(name, '-', 2) AS b, split_part(name, '-', 3) AS c FROM s),
v AS (SELECT name AS suspect, a || '-' || b AS target, 'suffix' AS position, c AS token, c IN ('2', '3', '4') AS is_filler FROM x UNION ALL SELECT name, b || '-' || c, 'prefix', a, false FROM x UNION ALL SELECT name, a || '-' || c, 'infix', b, false FROM x),
every AS (SELECT name FROM t UNION SELECT b || '-' || c FROM x UNION SELECT a || '-' || c FROM x) SELECT v.* FROM v JOIN every ON every.name = v.target""",
    "q15_scope": f"""WITH s AS (SELECT name FROM {names("-")}), t AS (SELECT '@' || substr(name, 1, 1) || '/' || name AS name, substr(name, 1, 1) AS sc, name AS rest FROM s), u AS (SELECT '@z/' || name AS name, name AS rest FROM s WHERE name LIKE '%1')
SELECT name AS suspect, '@' || substr(name, 1, 1) || '/' || name AS target, 'scope_dropped' AS variety, name AS form FROM s
UNION ALL SELECT u.name, t.name, 'scope_swapped', t.rest FROM u JOIN t USING (rest) UNION ALL SELECT u.name, s.name, 'scope_added', s.name FROM u JOIN s ON s.name = u.rest
UNION ALL SELECT substr(name, 1, 1) || '-' || name, '@' || substr(name, 1, 1) || '/' || name, 'scope_flattened', substr(name, 1, 1) || replace(name, '-', '') FROM s WHERE name LIKE '%2'""",
    "q16_findings": f"""WITH s AS (SELECT * FROM {names("-")}), t AS (SELECT * FROM {names("-", False)}),
p AS (SELECT s.name AS suspect, t.name AS target, t.dl AS tdl, CASE WHEN abs(length(s.name) - length(t.name)) <= 2 AND damerau_levenshtein(s.name, t.name) <= 2 THEN CAST(damerau_levenshtein(s.name, t.name) AS INTEGER) ELSE -1 END AS edit_distance,
  split_part(s.name, '-', 1) || '-' || split_part(s.name, '-', 2) = t.name AS padded FROM s JOIN t ON t.dl / greatest(s.dl, 1) >= 10),
f AS (SELECT *, concat_ws(',', CASE WHEN edit_distance >= 0 THEN 'edit_distance' END, CASE WHEN padded THEN 'padding' END, 'popularity_gap') AS kinds FROM p WHERE padded OR edit_distance >= 0)
SELECT suspect, target, CASE WHEN edit_distance BETWEEN 0 AND 1 THEN 'high' ELSE 'medium' END AS confidence, edit_distance, count(*) OVER (PARTITION BY suspect) AS matched,
CAST(row_number() OVER (PARTITION BY suspect ORDER BY CASE WHEN edit_distance BETWEEN 0 AND 1 THEN 0 ELSE 1 END, CASE WHEN edit_distance < 0 THEN 5 ELSE edit_distance END, tdl DESC, target) AS INTEGER) AS rank, kinds FROM f""",
    "q16_mirrored": f"""SELECT least(s.name, t.name) AS a, greatest(s.name, t.name) AS b, count(*) > 1 AS is_mirrored, 1 AS edit_distance FROM {names("-")} s, {names("-")} t
WHERE s.name <> t.name AND abs(length(s.name) - length(t.name)) <= 1 AND damerau_levenshtein(s.name, t.name) <= 1 GROUP BY 1, 2""",
    "q16_compared": f"""WITH n AS (SELECT 'npm' AS ecosystem, count(*) AS compared FROM {names("-")} UNION ALL SELECT 'pypi', count(*) FROM {names("-", False)})
SELECT ecosystem, compared, (SELECT sum(compared) FROM n)::BIGINT - compared AS other_ecosystem FROM n""",
    "q17_scan": f"{SCAN} SELECT * FROM scanned",
    "q17_file_verdicts": f"""{SCAN} SELECT path, count(CASE WHEN verdict = 'exposed' THEN 1 END) AS exposed, count(CASE WHEN verdict = 'unknown' THEN 1 END) AS unknown, count(CASE WHEN verdict = 'not_exposed' THEN 1 END) AS not_exposed,
CASE WHEN bool_or(verdict = 'exposed') THEN 'exposed' WHEN bool_or(verdict = 'unknown') THEN 'unknown' ELSE 'not_exposed' END AS verdict FROM scanned GROUP BY path""",
    "q18_line_scan": r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) AS n FROM documents),
p AS (SELECT * FROM (VALUES ('license', '(?i)licensed under the \w+ license'), ('credential', '(?i)\b(?:password|secret|token)\b'), ('table', '\w+ \| \w+ \| \w+')) v(pattern, re))
SELECT doc_id, pattern, CAST(min(n) AS INTEGER) AS line_number FROM l JOIN p ON regexp_matches(line, re) GROUP BY doc_id, pattern""",
    "q19_merged_nodes": f"""WITH {READINGS} SELECT coalesce(a.key, b.key) AS key, coalesce(a.name, b.name) AS name, coalesce(a.size, b.size) AS size, coalesce(a.brand, b.brand) AS brand, a.key IS NOT NULL AS in_first FROM first a FULL JOIN second b ON a.key = b.key""",
    "q19_conflicts": f"""WITH {READINGS} SELECT a.key, 'name' AS property, a.name AS kept, b.name AS dropped FROM first a JOIN second b ON a.key = b.key WHERE a.name <> b.name
UNION ALL SELECT a.key, 'size', a.size::VARCHAR, b.size::VARCHAR FROM first a JOIN second b ON a.key = b.key WHERE a.size <> b.size UNION ALL SELECT a.key, 'brand', a.brand, b.brand FROM first a JOIN second b ON a.key = b.key WHERE a.brand <> b.brand""",
    "q19_coverage": """SELECT 'package' AS subject_kind, 'npm:part-' || p_partkey AS key, CAST(least(CASE WHEN p_size < 30 THEN CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END ELSE 9 END, CASE WHEN p_size > 10 THEN CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END ELSE 9 END) AS INTEGER) AS level
FROM part WHERE p_size < 30 OR p_size > 10""",
    "q19_upsert": f"""WITH {READINGS} SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NOT NULL THEN b.key ELSE a.key END AS key, CASE WHEN b.id IS NOT NULL THEN b.name ELSE a.name END AS name, CASE WHEN b.id IS NOT NULL THEN b.size ELSE a.size END AS size,
CASE WHEN b.id IS NOT NULL THEN b.brand ELSE a.brand END AS brand FROM first a FULL JOIN second b ON a.id = b.id""",
    "q20_integrity": """SELECT 'duplicate line id' AS issue, l_orderkey * 100 + l_linenumber AS id FROM lineitem GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'line: no such src', l_orderkey * 100 + l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""",
    "q21_partial_closure": f"""WITH RECURSIVE {DEPS}, r AS (SELECT p_partkey AS node FROM part WHERE p_size = 50 UNION SELECT d.src FROM r JOIN deps d ON d.dst = r.node) SELECT node FROM r""",
    "q21_coverage_levels": f"""WITH RECURSIVE {DEPS}, {PINS}, r AS (SELECT p_partkey AS node FROM part WHERE p_size = 50 UNION SELECT d.src FROM r JOIN deps d ON d.dst = r.node)
SELECT 'package' AS subject_kind, 'npm:' || p_name AS key, CAST(min(CASE WHEN node IS NULL THEN 2 ELSE 1 END) AS INTEGER) AS level FROM part LEFT JOIN r ON node = p_partkey GROUP BY p_name
UNION ALL SELECT 'service', 'svc:' || src, 2 FROM pins LEFT JOIN r ON node = dst GROUP BY src HAVING bool_and(node IS NULL)""",
    "q22_history": """SELECT o_custkey AS service, l_partkey AS version, min(epoch_ms(o_orderdate)) AS first_seen_ms, max(epoch_ms(o_orderdate)) AS last_seen_ms, count(DISTINCT o_orderkey) AS revisions
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "q22_history_coverage": """WITH p AS (SELECT o_custkey::VARCHAR AS service, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) > 0 AS a, NOT min(epoch_ms(o_orderdate)) < 852076800000 AS b FROM orders GROUP BY 1)
SELECT service, a OR b AS is_partial, concat_ws('; ', CASE WHEN a THEN 'revisions were skipped' END, CASE WHEN b THEN 'the history starts too late' END) AS reasons FROM p""",
    "q23_trace": f"""WITH RECURSIVE {DEPS}, {SEEDS}, {PINS}, {walk(8)},
reach AS (SELECT source, tail AS node, min(hop) AS hop, arg_min(nodes, {{'h': hop, 'e': edges}}) AS nodes FROM walk GROUP BY ALL),
hit AS (SELECT r.source, p.src AS service, r.hop, list_reverse(r.nodes) AS nodes, row_number() OVER (PARTITION BY r.source, p.src ORDER BY r.hop, p.ms, p.src * 10000000 + p.dst) AS rk FROM pins p JOIN reach r ON p.dst = r.node),
far AS (SELECT * FROM hit WHERE rk = 1 AND hop > 0),
steps AS (SELECT service || '/' || source AS k, 'svc:' || service AS key, 0 AS pos, false AS pinned FROM far
  UNION ALL SELECT k, node::VARCHAR, pos::INTEGER, pos = 1 FROM (SELECT service || '/' || source AS k, unnest(nodes) AS node, generate_subscripts(nodes, 1) AS pos FROM far))
SELECT key, CAST(min(pos) AS INTEGER) AS hop, count(DISTINCT k) AS services, bool_or(pinned) AS is_pinned FROM steps GROUP BY key""",
    "q24_requirements": f"""WITH {PINS} SELECT DISTINCT src || '/requirements.txt' AS path, 'pypi' AS ecosystem, 'part-' || dst AS name, CASE WHEN p_size <= 40 THEN p_size || '.0' END AS version, false AS is_dev_only FROM pins JOIN part ON p_partkey = dst""",
    "q24_package_lock": """SELECT l_orderkey || '/package-lock.json' AS path, 'part-' || l_partkey AS name, min(l_linenumber) || '.0.0' AS version, bool_and(l_returnflag = 'N') AS is_dev_only, CASE WHEN min(l_linenumber) > 4 THEN 1 ELSE 0 END AS depth
FROM lineitem GROUP BY l_orderkey, l_partkey""",
    "q25_expiring_first_pin": "SELECT user_id::BIGINT AS service, k.version, min(epoch_us(ts) // 1000) AS resolved_at_ms FROM events JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type)::BIGINT AS version FROM (SELECT DISTINCT event_type FROM events)) k USING (event_type) GROUP BY 1, 2",
    "q25_stream_first_pin": "SELECT o_custkey AS service, l_partkey AS version, min(epoch_ms(o_orderdate)) AS resolved_at_ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "q26_keys": """WITH k AS (SELECT p_partkey, '@' || lower(replace(p_type, ' ', '-')) || '/' || replace(p_name, ' ', ':') AS name, p_size || '.0.0' AS version FROM part)
SELECT p_partkey, 'npm:' || name || ':' || version AS key, name, version, name || '@' || version AS shown, regexp_matches('npm:' || name || ':' || version, '^[A-Za-z0-9._~+@/:-]+$') AS is_selectable, 'npm:' || name AS package_key FROM k""",
    "q26_formats": f"""WITH {FACTS}, s AS (SELECT id, lines, pub, dis - pub AS span FROM facts) SELECT id, format('{{:,}}', lines * 1000) AS shown_count, strftime(make_timestamp(pub * 1000), '%Y-%m-%d') AS day,
CASE WHEN abs(span) >= 86400000 THEN 'day' WHEN abs(span) >= 3600000 THEN 'hour' ELSE 'minute' END AS unit,
CASE WHEN abs(span) >= 86400000 THEN round(span / 86400000, 1) WHEN abs(span) >= 3600000 THEN round(span / 3600000, 1) ELSE round(span / 60000, 0) END AS amount FROM s""",
    "q26_summaries": r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, md5(CASE WHEN length(t) > 480 THEN substr(t, 1, 480) || '...' ELSE t END) AS digest FROM f""",
    "q27_crawl": f"""WITH RECURSIVE {DEPS}, {SEEDS}, l0 AS (SELECT node AS key FROM seeds), l1 AS (SELECT DISTINCT src AS key FROM deps JOIN l0 ON dst = l0.key WHERE src NOT IN (SELECT key FROM l0) ORDER BY 1 LIMIT (145)),
l2 AS (SELECT DISTINCT src AS key FROM deps JOIN l1 ON dst = l1.key WHERE src NOT IN (SELECT key FROM l0) AND src NOT IN (SELECT key FROM l1) ORDER BY 1 LIMIT (SELECT greatest(0, 145 - count(*)) FROM l1)),
l3 AS (SELECT DISTINCT src AS key FROM deps JOIN l2 ON dst = l2.key WHERE src NOT IN (SELECT key FROM l0) AND src NOT IN (SELECT key FROM l1) AND src NOT IN (SELECT key FROM l2) ORDER BY 1 LIMIT (SELECT greatest(0, 145 - count(*) - (SELECT count(*) FROM l2)) FROM l1))
SELECT key, 0 AS depth FROM l0 UNION ALL SELECT key, 1 FROM l1 UNION ALL SELECT key, 2 FROM l2 UNION ALL SELECT key, 3 FROM l3""",
    "q27_select_versions": f"""WITH {FACTS} SELECT name, version, CAST(rank AS INTEGER) AS rank FROM (SELECT p_name AS name, p_partkey::VARCHAR AS version,
row_number() OVER (PARTITION BY p_name ORDER BY CASE WHEN p_size = 50 THEN 0 WHEN p_size < 5 THEN 1 ELSE 2 END, pub DESC NULLS LAST, p_partkey::VARCHAR) AS rank FROM part LEFT JOIN facts ON id = p_partkey) WHERE rank <= 3""",
    "q28_id_map": """WITH k AS (SELECT 'Package' AS label, format('part-{:08d}', p_partkey) AS key, p_partkey, p_size FROM part)
SELECT label, key, p_partkey AS id FROM k WHERE p_size <= 25 UNION ALL SELECT label, key, (SELECT coalesce(max(p_partkey), 0) FROM k WHERE p_size <= 25) + row_number() OVER (ORDER BY key) FROM k WHERE p_size > 25""",
    "q28_last_write": """SELECT id, ship_ms, l_partkey FROM (SELECT l_orderkey * 100 + l_linenumber AS id, epoch_ms(l_shipdate) AS ship_ms, l_partkey,
row_number() OVER (PARTITION BY l_orderkey * 100 + l_linenumber ORDER BY epoch_ms(l_shipdate) DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS r FROM lineitem) WHERE r = 1""",
    "q29_reach_of_names": f"""WITH {DEPS}, {PINS}, a AS (SELECT dst AS package, count(DISTINCT src) AS dependents FROM deps GROUP BY 1), b AS (SELECT dst AS package, count(DISTINCT src) AS services FROM pins JOIN part ON p_partkey = dst GROUP BY 1)
SELECT coalesce(a.package, b.package) AS package, coalesce(dependents, 0) AS dependents, coalesce(services, 0) AS services FROM a FULL JOIN b ON a.package = b.package""",
    "q30_event_exposure": """WITH w AS (SELECT user_id, min(CASE WHEN event_type = 'error' THEN epoch_us(ts) // 1000 END) AS a, min(CASE WHEN event_type = 'purchase' THEN epoch_us(ts) // 1000 END) AS b FROM events GROUP BY 1)
SELECT user_id, count(*) AS clicks, min(epoch_us(ts) // 1000) AS first_ms FROM events JOIN w USING (user_id) WHERE event_type = 'click' AND epoch_us(ts) // 1000 >= a AND epoch_us(ts) // 1000 < b GROUP BY user_id""",
}
ORACLES |= {"q05_bucketed_reach": ORACLES["q05_reach"], "q19_partitioned_upsert": ORACLES["q19_upsert"]}
