"""The same results in DuckDB's SQL."""

from __future__ import annotations

LINES = """lines AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, a.l_quantity AS w, b.l_quantity AS q, a.l_discount AS dc, a.l_returnflag AS rf
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"""
WHERE = {1: "true", 2: "w >= 25 AND q >= 25 AND rf = 'R'", 3: "dc >= 0.09 AND q >= 30"}


def edges(kind: int) -> str:
    return f"{LINES}, e AS (SELECT src, dst, min(w) AS weight, count(*) AS mult FROM lines WHERE {WHERE[kind]} GROUP BY 1, 2), v AS (SELECT p_partkey AS id FROM part)"


def over(kind: int, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{edges(kind)}{body}"


DEG = ", deg AS (SELECT id, count(src) AS degree FROM v LEFT JOIN e ON src = id GROUP BY id)"
X = ", s AS (SELECT id, (id * 7919) % 1000 AS x FROM v)"
UND = ", u AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) WHERE src <> dst)"

BFS = ", b(id, level) USING KEY (id) AS (SELECT min(src), 1 FROM e UNION SELECT DISTINCT e.dst, b.level + 1 FROM b JOIN e ON e.src = b.id WHERE NOT EXISTS (SELECT 1 FROM recurring.b r WHERE r.id = e.dst))"
LEVELS = f"{BFS}, lv AS (SELECT v.id, coalesce(b.level, -1)::INTEGER AS level FROM v LEFT JOIN b USING (id))"
CC = ", c(id, component) USING KEY (id) AS (SELECT id, id FROM v UNION SELECT u.dst, min(c.component) FROM c JOIN u ON u.src = c.id JOIN recurring.c r ON r.id = u.dst GROUP BY u.dst HAVING min(c.component) < min(r.component))"
SSSP = ", d(id, x) USING KEY (id) AS (SELECT min(src), 0.0::DOUBLE FROM e UNION SELECT e.dst, min(d.x + e.weight) FROM d JOIN e ON e.src = d.id LEFT JOIN recurring.d r ON r.id = e.dst GROUP BY e.dst HAVING min(d.x + e.weight) < coalesce(min(r.x), 1e300))"
SSWP = ", d(id, x) USING KEY (id) AS (SELECT min(src), 3.4028234663852886e38::DOUBLE FROM e UNION SELECT e.dst, max(least(d.x, e.weight)) FROM d JOIN e ON e.src = d.id LEFT JOIN recurring.d r ON r.id = e.dst GROUP BY e.dst HAVING max(least(d.x, e.weight)) > coalesce(max(r.x), 0))"
CLOSURE = ", r(s, t) AS (SELECT src, dst FROM e UNION SELECT r.s, e.dst FROM r JOIN e ON e.src = r.t)"
SCC = f"{CLOSURE}, m AS (SELECT a.s AS id, min(a.t) AS low FROM r a JOIN r b ON a.s = b.t AND a.t = b.s GROUP BY 1), k AS (SELECT v.id, least(v.id, coalesce(m.low, v.id)) AS component FROM v LEFT JOIN m USING (id))"


def page_rank(kind: int, a: str, b: str, iterations: int = 5) -> str:
    body = f", n AS (SELECT count(*)::DOUBLE AS n FROM v), arcs AS (SELECT {a} AS src, {b} AS dst FROM e WHERE src <> dst), g AS (SELECT id, count(src) AS d FROM v LEFT JOIN arcs ON src = id GROUP BY id), r0 AS (SELECT id, d, 1 / n AS r FROM g, n)"
    for k in range(iterations):
        body += f", t{k} AS (SELECT arcs.dst AS id, sum(r / d) AS m FROM r{k} JOIN arcs ON arcs.src = r{k}.id GROUP BY 1), h{k} AS (SELECT coalesce(sum(r) FILTER (WHERE d = 0), 0) AS h FROM r{k})"
        body += f", r{k + 1} AS (SELECT r{k}.id, r{k}.d, 0.15 / n + 0.85 * (coalesce(m, 0) + h / n) AS r FROM r{k} LEFT JOIN t{k} USING (id), h{k}, n)"
    return over(kind, body + f" SELECT id, round(r, 10) AS rank FROM r{iterations}")


def hits(kind: int, steps: int = 3) -> str:
    body = ", h0 AS (SELECT id, 1.0::DOUBLE AS x FROM v)"
    for k in range(steps):
        body += f", ra{k} AS (SELECT v.id, coalesce(sum(h{k}.x), 0) AS x FROM v LEFT JOIN e ON e.dst = v.id LEFT JOIN h{k} ON h{k}.id = e.src GROUP BY v.id), a{k} AS (SELECT id, x / (SELECT sqrt(sum(x * x)) FROM ra{k}) AS x FROM ra{k})"
        body += f", rh{k} AS (SELECT v.id, coalesce(sum(a{k}.x), 0) AS x FROM v LEFT JOIN e ON e.src = v.id LEFT JOIN a{k} ON a{k}.id = e.dst GROUP BY v.id), h{k + 1} AS (SELECT id, x / (SELECT sqrt(sum(x * x)) FROM rh{k}) AS x FROM rh{k})"
    return over(kind, body + f" SELECT id, round(a{steps - 1}.x, 8) AS authority, round(h{steps}.x, 8) AS hub FROM a{steps - 1} JOIN h{steps} USING (id)")


def label_steps(kind: int, n: int) -> str:
    body = ", l0 AS (SELECT id, id AS label FROM v)"
    for k in range(n):
        body += f", c{k} AS (SELECT e.src AS id, l{k}.label, count(*) AS n FROM e JOIN l{k} ON l{k}.id = e.dst GROUP BY 1, 2), w{k} AS (SELECT id, arg_max(label, n * 1000000000 + label) AS label FROM c{k} GROUP BY id), l{k + 1} AS (SELECT l{k}.id, coalesce(w{k}.label, l{k}.label) AS label FROM l{k} LEFT JOIN w{k} USING (id))"
    return over(kind, body)


def recent_steps(kind: int, n: int, patience: int = 4) -> str:
    """Vertices that didn't move for more than `patience` rounds rest for good."""
    body = ", l0 AS (SELECT id, id AS label, 0 AS rest FROM v)"
    for k in range(n):
        body += f", c{k} AS (SELECT e.src AS id, d.label, count(*) AS n FROM e JOIN l{k} s ON s.id = e.src AND s.rest <= {patience} JOIN l{k} d ON d.id = e.dst GROUP BY 1, 2), w{k} AS (SELECT id, arg_max(label, n * 1000000000 + label) AS label FROM c{k} GROUP BY id), l{k + 1} AS (SELECT l{k}.id, coalesce(w{k}.label, l{k}.label) AS label, CASE WHEN coalesce(w{k}.label <> l{k}.label, false) THEN 0 ELSE rest + 1 END AS rest FROM l{k} LEFT JOIN w{k} USING (id))"
    return over(kind, body + f" SELECT id, label FROM l{n}")


WALK = """, a AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS n, count(*) OVER (PARTITION BY src) AS d FROM e),
      w(t, walk, cur) AS (SELECT 0, id, id FROM v UNION ALL SELECT t + 1, walk, coalesce(a.dst, -1) FROM w LEFT JOIN a ON a.src = w.cur AND a.n = (w.walk * 7919 + w.t * 104729 + 42) % a.d WHERE t < 10)
      SELECT walk, walk AS start, cur AS "end" FROM w WHERE t = 10"""


def previous_steps(kind: int, n: int) -> str:
    """Only vertices that moved last round look again."""
    body = ", l0 AS (SELECT id, id AS label, true AS active FROM v)"
    for k in range(n):
        body += f", c{k} AS (SELECT e.src AS id, d.label, count(*) AS n FROM e JOIN l{k} s ON s.id = e.src AND s.active JOIN l{k} d ON d.id = e.dst GROUP BY 1, 2), w{k} AS (SELECT id, arg_max(label, n * 1000000000 + label) AS label FROM c{k} GROUP BY id), l{k + 1} AS (SELECT l{k}.id, coalesce(w{k}.label, l{k}.label) AS label, coalesce(w{k}.label <> l{k}.label, false) AS active FROM l{k} LEFT JOIN w{k} USING (id))"
    return over(kind, body + f" SELECT id, label FROM l{n}")


def inner_steps(kind: int, n: int) -> str:
    """Vertices rest while their label surrounds them, until enough neighbours move."""
    body = ", l0 AS (SELECT id, id AS label, true AS active FROM v)"
    for k in range(n):
        body += f", c{k} AS (SELECT e.src AS id, d.label, count(*) AS n FROM e JOIN l{k} s ON s.id = e.src AND s.active JOIN l{k} d ON d.id = e.dst GROUP BY 1, 2), w{k} AS (SELECT id, arg_max(label, n * 1000000000 + label) AS label, count(*) AS kinds FROM c{k} GROUP BY id), m{k} AS (SELECT l{k}.id, l{k}.active, coalesce(w{k}.label, l{k}.label) AS label, coalesce(w{k}.label <> l{k}.label, false) AS moved, coalesce(kinds, 0) AS kinds FROM l{k} LEFT JOIN w{k} USING (id)), p{k} AS (SELECT e.src AS id, avg(m{k}.moved::INT) AS share FROM e JOIN m{k} ON m{k}.id = e.dst GROUP BY 1), l{k + 1} AS (SELECT m{k}.id, label, (active AND kinds > 1) OR coalesce(share, 0) > 0.006 AS active FROM m{k} LEFT JOIN p{k} USING (id))"
    return over(kind, body + f" SELECT id, label FROM l{n}")


RESULTS = "r AS (SELECT l_returnflag AS app_name, l_linenumber::VARCHAR AS graph_name, 'arch' || (l_suppkey % 10)::VARCHAR AS arch_name, max(l_extendedprice) AS perf_val FROM lineitem GROUP BY 1, 2, 3)"
NORM = f"WITH {RESULTS}, n AS (SELECT *, perf_val / max(perf_val) OVER (PARTITION BY app_name, graph_name) AS norm FROM r)"
NAMES = "g AS (SELECT CASE n_nationkey % 5 WHEN 0 THEN 'web_' || lower(n_name) WHEN 1 THEN 'soc_' || lower(n_name) WHEN 2 THEN 'rating_' || lower(n_name) WHEN 3 THEN 'road_' || lower(n_name) ELSE 'syn_rmat_' || (n_nationkey + 1)::VARCHAR || '_32' END AS graph_name FROM nation)"
PAIRS = ", p AS (SELECT i AS pair_id, (i * 7919) % (SELECT count(*) FROM v) AS src, (i * 104729 + 1) % (SELECT count(*) FROM v) AS dst FROM range(500) t(i))"
TC = over(2, f"{PAIRS}, r(s, t) AS (SELECT DISTINCT src, src FROM p UNION SELECT r.s, e.dst FROM r JOIN e ON e.src = r.t) SELECT pair_id, src, dst, EXISTS (SELECT 1 FROM r WHERE s = src AND t = dst) AS reachable FROM p", True)
SIZES = "SELECT size, count(*) AS components FROM (SELECT count(*) AS size FROM {0} GROUP BY component) GROUP BY size"

ORACLES = {
    **{f"edge_build_g{k}": over(k, " SELECT src, dst, weight, mult FROM e") for k in (1, 2, 3)},
    "out_degree": over(1, DEG + " SELECT * FROM deg"),
    "in_degree": over(1, " SELECT id, count(dst) AS degree FROM v LEFT JOIN e ON dst = id GROUP BY id"),
    "degree_report": over(1, DEG + " SELECT count(*) AS vertices, sum(degree)::BIGINT AS edges, (sum(degree)::BIGINT // count(*)) AS average_degree, max(degree) AS highest, round(100.0::DOUBLE * max(degree) / sum(degree)::BIGINT, 6) AS highest_percent, (count(*) FILTER (WHERE degree = 0) * 100 // count(*)) AS zero_percent FROM deg"),
    "degree_histogram": over(2, DEG + " SELECT CASE WHEN degree = 0 THEN -1 ELSE floor(log2(degree)) END::BIGINT AS bucket, count(*) AS vertices FROM deg GROUP BY 1"),
    "degree_buckets": over(1, DEG + ", k AS (SELECT degree, CASE WHEN degree >= 256 THEN 0 WHEN degree >= 128 THEN 1 WHEN degree >= 64 THEN 2 WHEN degree >= 32 THEN 3 WHEN degree >= 16 THEN 4 ELSE 5 END::INTEGER AS bucket FROM deg) SELECT bucket, count(*) AS vertices, sum(degree)::BIGINT AS edges, round(100.0::DOUBLE * sum(degree)::BIGINT / (SELECT count(*) FROM e), 6) AS percent FROM k GROUP BY bucket"),
    "hub_share": over(1, DEG + ", k AS (SELECT degree, row_number() OVER (ORDER BY degree DESC) AS n FROM deg) SELECT round(sum(degree)::DOUBLE / (SELECT count(*) FROM e), 6) AS share FROM k WHERE n <= greatest(1, (SELECT count(*) FROM v) // 100)"),
    "top_degree": over(1, DEG + " SELECT * FROM deg ORDER BY degree DESC, id LIMIT 20"),
    "isolated_vertices": over(2, " SELECT id FROM v WHERE id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)"),
    "vertices_with_arcs": over(2, " SELECT count(DISTINCT src) AS n FROM e"),
    "transpose_degree": over(2, " SELECT id, count(dst) AS degree FROM v LEFT JOIN e ON dst = id GROUP BY id"),
    "symmetrize_count": over(2, " SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) GROUP BY 1, 2"),
    "dedup_arcs": over(2, " SELECT src, dst FROM e UNION SELECT dst, src FROM e"),
    "self_loops": over(1, " SELECT count(*) AS arcs FROM e WHERE src <> dst"),
    "renumber_by_degree": over(1, DEG + " SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id) - 1 AS new_id FROM deg"),
    "renumbered_degrees": over(1, DEG + " SELECT row_number() OVER (ORDER BY degree DESC, id) - 1 AS id, degree FROM deg"),
    "adjacency_sorted": over(2, " SELECT src AS id, string_agg(dst::VARCHAR, ' ' ORDER BY dst) AS neighbours FROM e GROUP BY src"),
    "first_neighbours": over(1, " SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM e) WHERE n <= 5"),
    "csr_offsets": over(1, DEG + ' SELECT id, coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", degree FROM deg'),
    "ligra_lines": over(1, DEG + ", o AS (SELECT id, coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM deg) SELECT 0 AS section, 0::BIGINT AS place, 'AdjacencyGraph' AS value UNION ALL SELECT 0, 1, count(*)::VARCHAR FROM v UNION ALL SELECT 0, 2, count(*)::VARCHAR FROM e UNION ALL SELECT 1, id, o::VARCHAR FROM o UNION ALL SELECT 2, src, dst::VARCHAR FROM e"),
    "edge_segments": over(1, " SELECT dst // 512 AS dst_segment, src // 512 AS src_segment, count(*) AS arcs FROM e GROUP BY 1, 2"),
    "edge_lookup": over(1, " SELECT src, dst, weight FROM e WHERE src = 3 AND dst = 5 UNION ALL SELECT src, dst, weight FROM e WHERE src = dst"),
    "edge_list_lines": over(2, ", z AS (SELECT CASE WHEN min(least(src, dst)) = 0 THEN 1 ELSE 0 END AS z FROM e) SELECT (src + z)::VARCHAR || ' ' || (dst + z)::VARCHAR AS value FROM e, z"),
    "frontier_gnf": over(1, DEG + " SELECT id FROM deg WHERE degree > 15"),
    "frontier_stats": over(1, DEG + ", k AS (SELECT count(*) FILTER (WHERE degree > 15) AS size, coalesce(sum(degree) FILTER (WHERE degree > 15), 0)::BIGINT AS neighbours, count(*) AS v FROM deg) SELECT size, neighbours, CASE WHEN size = v THEN 'ALL_ACTIVE' WHEN size / v > 0.7 THEN 'DENSE' ELSE 'SPARSE' END AS sparsity FROM k"),
    "scatter_min": over(1, X + " SELECT dst AS id, min(x + weight::BIGINT) AS message FROM e JOIN s ON s.id = src GROUP BY 1"),
    "scatter_max": over(1, X + " SELECT dst AS id, max(x + weight::BIGINT) AS message FROM e JOIN s ON s.id = src GROUP BY 1"),
    "scatter_sum": over(1, X + " SELECT dst AS id, sum(x)::BIGINT AS message FROM e JOIN s ON s.id = src GROUP BY 1"),
    "gather_min": over(1, X + " SELECT src AS id, min(x + weight::BIGINT) AS message FROM e JOIN s ON s.id = dst GROUP BY 1"),
    "gather_sum": over(1, X + " SELECT dst AS id, sum(x)::BIGINT AS message FROM e JOIN s ON s.id = src GROUP BY 1"),
    "scatter_frontier": over(1, X + " SELECT dst AS id, max(x) AS message FROM e JOIN s ON s.id = src WHERE x < 100 AND weight > 10 GROUP BY 1"),
    "vertex_compute": over(1, X + " SELECT id, CASE WHEN x >= 500 THEN x * 2 ELSE x END AS x FROM s"),
    "exchange_max": over(1, X + " SELECT id, greatest(x, CASE WHEN id % 3 = 0 THEN x + 5 ELSE x - 1 END) AS x FROM s"),
    "sparsity_matrix": over(1, ", z AS (SELECT (count(*) - 1) // 256 + 1 AS z FROM v) SELECT src // z AS row, dst // z AS col, round(count(*)::DOUBLE / (SELECT count(*) FROM e), 10) AS share FROM e, z GROUP BY 1, 2"),
    "sparsity_features": over(1, " SELECT (SELECT count(*) FROM v) / 67108864.0::DOUBLE AS size, (SELECT count(*) FROM e) // (SELECT count(*) FROM v) AS average_degree"),
    "bfs_levels": over(2, LEVELS + " SELECT * FROM lv", True), "bfs_pull": over(2, LEVELS + " SELECT * FROM lv", True), "bfs_auto": over(1, LEVELS + " SELECT * FROM lv", True),
    "bfs_level_sizes": over(2, LEVELS + " SELECT level, count(*) AS vertices FROM lv GROUP BY level", True),
    **{f"sssp_{k}": over(2, SSSP + " SELECT v.id, coalesce(x, 3.4028234663852886e38) AS distance FROM v LEFT JOIN d USING (id)", True) for k in ("push", "pull", "delta")},
    "sswp": over(2, SSWP + " SELECT v.id, coalesce(x, 0) AS width FROM v LEFT JOIN d USING (id)", True),
    "pagerank": page_rank(1, "src", "dst"), "pagerank_transpose": page_rank(2, "dst", "src"), "hits": hits(2),
    "cc_labels": over(2, UND + CC + " SELECT * FROM c", True), "cc_bfs": over(3, UND + CC + " SELECT * FROM c", True),
    "cc_sizes": over(3, UND + CC + " " + SIZES.format("c"), True),
    "cc_report": over(3, UND + CC + ", z AS (SELECT count(*) AS size FROM c GROUP BY component) SELECT count(*) AS components, max(size) AS largest, count(*) FILTER (WHERE size > 1) AS non_trivial FROM z", True),
    "cc_numbered": over(3, UND + CC + " SELECT id, dense_rank() OVER (ORDER BY component) AS component FROM c", True),
    "scc_labels": over(2, SCC + " SELECT * FROM k", True), "scc_sizes": over(3, SCC + " " + SIZES.format("k"), True),
    "condensation": over(2, SCC + " SELECT DISTINCT a.component AS src, b.component AS dst FROM e JOIN k a ON a.id = src JOIN k b ON b.id = dst WHERE a.component <> b.component", True),
    "tc_pairs": TC, "tc_pairs_bfs": TC,
    "label_prop": label_steps(2, 3) + " SELECT id, label FROM l3", "label_prop_dense": label_steps(1, 3) + " SELECT id, label FROM l3", "label_prop_recent": recent_steps(2, 8), "label_prop_previous": previous_steps(2, 3), "label_prop_inner": inner_steps(2, 3),
    "community_sizes": label_steps(2, 3) + " SELECT label, count(*) AS size FROM l3 GROUP BY label",
    "coloring": over(2, UND + """, o AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM v), lo AS (SELECT dst AS id, list(src) AS low FROM u WHERE src < dst GROUP BY dst),
      c(n, id, colour) USING KEY (id) AS (SELECT 1::BIGINT, min(id), 0::BIGINT FROM o UNION
        SELECT o.n, o.id, (SELECT min(k) FROM range(0, 64) t(k) WHERE k NOT IN (SELECT r.colour FROM recurring.c r WHERE list_contains(lo.low, r.id)))
        FROM (SELECT max(n) AS n FROM c) m JOIN o ON o.n = m.n + 1 LEFT JOIN lo USING (id))
      SELECT id, colour FROM c""", True),
    "coloring_check": over(2, " SELECT count(*) AS conflicts FROM e WHERE src <> dst AND src = dst"),
    "random_walk": over(2, WALK, True), "random_walk_dense": over(1, WALK, True),
    "bfs_dense": over(1, LEVELS + " SELECT * FROM lv", True), "cc_dense": over(1, UND + CC + " SELECT * FROM c", True), "hits_dense": hits(1),
    **{f"{k}_dense": over(1, SSSP + " SELECT v.id, coalesce(x, 3.4028234663852886e38) AS distance FROM v LEFT JOIN d USING (id)", True) for k in ("sssp", "sssp_pull")},
    "sswp_dense": over(1, SSWP + " SELECT v.id, coalesce(x, 0) AS width FROM v LEFT JOIN d USING (id)", True),
    "perf_find": f"WITH {RESULTS} SELECT graph_name, arch_name, perf_val FROM r WHERE app_name = 'A'",
    "perf_distinct": f"WITH {RESULTS} SELECT DISTINCT arch_name FROM r WHERE app_name = 'R'",
    "perf_update": f"WITH {RESULTS} SELECT app_name, graph_name, arch_name, CASE WHEN arch_name = 'arch3' THEN 1.0 ELSE perf_val END::DOUBLE AS perf_val FROM r",
    "perf_remove": f"WITH {RESULTS} SELECT * FROM r WHERE arch_name <> 'arch3'",
    "perf_normalised": NORM + " SELECT app_name, graph_name, arch_name, perf_val, round(norm, 10) AS norm FROM n",
    "perf_rating": NORM + ", z AS (SELECT arch_name, round(sum(0.5::DOUBLE * norm), 2) AS rating FROM n GROUP BY 1) SELECT arch_name, rating, row_number() OVER (ORDER BY rating DESC, arch_name)::INTEGER AS position FROM z",
    "perf_rating_sliders": NORM + ", z AS (SELECT arch_name, round(sum(0.5::DOUBLE * CASE WHEN graph_name < '4' THEN 1.0 ELSE 0.2 END::DOUBLE * CASE app_name WHEN 'A' THEN 0.3 WHEN 'N' THEN 0.6 ELSE 0.9 END::DOUBLE * norm), 2) AS rating FROM n GROUP BY 1) SELECT arch_name, rating, row_number() OVER (ORDER BY rating DESC, arch_name)::INTEGER AS position FROM z",
    "perf_upsert_max": f"WITH {RESULTS} SELECT graph_name, arch_name, app_name, CASE WHEN arch_name < 'arch5' AND graph_name > '3' THEN perf_val * 2 ELSE perf_val END AS perf_val FROM r",
    "perf_table": f"WITH {RESULTS} SELECT app_name, graph_name, arg_max(arch_name, (perf_val, arch_name)) AS best, count(*)::INTEGER AS n FROM r GROUP BY 1, 2",
    "best_format": f"WITH {RESULTS} SELECT graph_name, arg_min(arch_name, (-perf_val, arch_name)) AS format FROM r GROUP BY 1",
    "category_enrich": f"WITH {NAMES}, k AS (SELECT graph_name, CASE WHEN graph_name LIKE 'syn^_%' ESCAPE '^' THEN pow(2, split_part(graph_name, '_', 3)::INT) END AS n FROM g) SELECT graph_name, CASE WHEN starts_with(graph_name, 'web_') THEN 'Hyperlink network' WHEN starts_with(graph_name, 'soc_') THEN 'Online social network' WHEN starts_with(graph_name, 'rating_') THEN 'Rating network' WHEN starts_with(graph_name, 'road_') THEN 'Infrastructure network' ELSE 'synthetic' END AS graph_category, CASE WHEN n < 65536 THEN 'tiny_vertex_scale' WHEN n < 4194304 THEN 'small_vertex_scale' WHEN n < 16777216 THEN 'medium_vertex_scale' WHEN n IS NOT NULL THEN 'large_vertex_scale' END AS vertex_scale FROM k",
    "page_extract": r"""WITH p AS (SELECT *, regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1) AS links, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'), '<[^>]*>', chr(10), 'g') AS bare FROM pages)
      SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, len(links)::INTEGER AS n_links, links[1] AS first_link,
        len(list_filter(list_transform(regexp_split_to_array(bare, '\r?\n|  '), lambda x: trim(x, ' ')), lambda x: x <> ''))::INTEGER AS text_lines, TRY_CAST(regexp_replace(url, '[^0-9]', '', 'g') AS BIGINT) AS url_number FROM p""",
    "log_extract": "SELECT o_orderkey, round(o_totalprice, 2) AS perf, o_custkey % 7 AS errors FROM orders",
}
