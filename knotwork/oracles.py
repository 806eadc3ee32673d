"""SQL for DuckDB that answers the registered graph queries from definitions, by other ways than the engine's."""

from __future__ import annotations

from .functions.hashing import hash32_sql

MAIN = """SELECT DISTINCT least(x, y) AS src, greatest(x, y) AS dst FROM (
    SELECT c_custkey * 8 AS x, CAST(c_nationkey AS BIGINT) * 8 + 2 AS y FROM customer UNION ALL SELECT s_suppkey * 8 + 1, CAST(s_nationkey AS BIGINT) * 8 + 2 FROM supplier
    UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 8 + 2, CAST(n_regionkey AS BIGINT) * 8 + 3 FROM nation
    UNION ALL SELECT user_id * 8, (dense_rank() OVER (ORDER BY event_type) - 1) * 8 + 4 FROM events)"""
DENSE = "SELECT DISTINCT least(2 * l_partkey, 2 * l_suppkey + 1) AS src, greatest(2 * l_partkey, 2 * l_suppkey + 1) AS dst FROM lineitem"
PLACES = """SELECT DISTINCT least(x, y) AS src, greatest(x, y) AS dst FROM (
    SELECT c_custkey * 4 AS x, CAST(c_nationkey AS BIGINT) * 4 + 2 AS y FROM customer UNION ALL SELECT s_suppkey * 4 + 1, CAST(s_nationkey AS BIGINT) * 4 + 2 FROM supplier
    UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 4 + 2, CAST(n_regionkey AS BIGINT) * 4 + 3 FROM nation)"""
CUSTOMER_PART = """SELECT DISTINCT least(2 * o_custkey, 2 * l_partkey + 1) AS src, greatest(2 * o_custkey, 2 * l_partkey + 1) AS dst
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""
TURNS = "SELECT DISTINCT x.conv_id * 1000 + x.turn AS src, y.conv_id * 1000 + y.turn AS dst FROM conversations x JOIN conversations y ON x.conv_id * 1000 + x.turn + 1 = y.conv_id * 1000 + y.turn"
TURN_IDS = "SELECT DISTINCT conv_id * 1000 + turn AS v FROM conversations"

#: A step: its name and columns, what it needs, and its query.
STEPS: dict[str, tuple[str, tuple[str, ...], str]] = {
    "sym": ("sym(a, b)", (), "SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e"),
    "vtx": ("vtx(v)", ("sym",), "SELECT DISTINCT a FROM sym"),
    "deg": ("deg(v, degree)", ("sym",), "SELECT a, count(*) FROM sym GROUP BY a"),
    "cc": ("cc(v, c)", ("vtx",), "SELECT v, min(c) FROM cc0 GROUP BY v"),
    "root": ("root(v)", ("cc", "deg"), "SELECT v FROM (SELECT v, row_number() OVER (PARTITION BY c ORDER BY degree DESC, v) AS k FROM cc JOIN deg USING (v)) WHERE k = 1"),
    "lev": ("lev(v, level)", ("root",), "SELECT v, min(level) FROM lev0 GROUP BY v"),
    "tree": ("tree(v, parent, level, root)", ("lev",), """SELECT lev.v, (SELECT min(b) FROM sym JOIN lev l2 ON l2.v = sym.b WHERE sym.a = lev.v AND l2.level = lev.level - 1), lev.level, r.v
        FROM lev JOIN cc ON cc.v = lev.v JOIN cc c2 ON c2.c = cc.c JOIN root r ON r.v = c2.v"""),
    "anc": ("anc(v, a)", ("tree",), "SELECT v, a FROM anc0"),
    "nd": ("nd(v, n_desc)", ("anc",), "SELECT a, count(*) FROM anc GROUP BY a"),
    "pre": ("pre(v, pre)", ("tree",), "SELECT v, row_number() OVER (PARTITION BY root ORDER BY path) FROM paths"),
    "te": ("te(src, dst)", ("tree",), "SELECT least(v, parent), greatest(v, parent) FROM tree WHERE parent IS NOT NULL"),
    "nt": ("nt(src, dst)", ("te",), "SELECT src, dst FROM e EXCEPT SELECT src, dst FROM te"),
    "lh": ("lh(v, low, high)", ("nt", "pre", "anc"), """SELECT anc.a, min(p), max(p) FROM anc JOIN (SELECT v, pre AS p FROM pre UNION ALL SELECT src, pre FROM nt JOIN pre ON v = dst
        UNION ALL SELECT dst, pre FROM nt JOIN pre ON v = src) q ON q.v = anc.v GROUP BY anc.a"""),
    "lca": ("lca(src, dst, lca)", ("nt", "anc", "lev"), "SELECT src, dst, arg_max(x.a, level) FROM nt JOIN anc x ON x.v = src JOIN anc y ON y.v = dst AND y.a = x.a JOIN lev ON lev.v = x.a GROUP BY src, dst"),
    "cls": ("cls(x, s, t)", ("gx",), "SELECT x, s, min(gx.v) FROM gx JOIN sym ON a = x AND b = gx.v GROUP BY x, s"),
    "gx": ("gx(x, s, v)", ("sym",), "SELECT a, b, b FROM sym UNION SELECT gx.x, gx.s, sym.b FROM gx JOIN sym ON sym.a = gx.v WHERE sym.b <> gx.x"),
    "cc0": ("cc0(v, c)", ("vtx",), "SELECT v, v FROM vtx UNION SELECT sym.b, cc0.c FROM cc0 JOIN sym ON sym.a = cc0.v WHERE cc0.c < sym.b"),
    "lev0": ("lev0(v, level)", ("root",), "SELECT v, CAST(0 AS BIGINT) FROM root UNION SELECT sym.b, level + 1 FROM lev0 JOIN sym ON sym.a = lev0.v WHERE level < 40"),
    "anc0": ("anc0(v, a)", ("tree",), "SELECT v, v FROM tree UNION ALL SELECT anc0.v, tree.parent FROM anc0 JOIN tree ON tree.v = anc0.a WHERE tree.parent IS NOT NULL"),
    "paths": ("paths(v, root, path)", ("tree",), "SELECT v, v, [v] FROM tree WHERE parent IS NULL UNION ALL SELECT tree.v, paths.root, list_append(path, tree.v) FROM paths JOIN tree ON tree.parent = paths.v"),
    "same": ("same(p, q)", ("cls",), "SELECT least(x, s) * 2147483648 + greatest(x, s), least(x, t) * 2147483648 + greatest(x, t) FROM cls"),
    "near": ("near(p, q)", ("same",), "SELECT p, q FROM same UNION SELECT q, p FROM same"),
    "lab": ("lab(p, m)", ("near",), "SELECT DISTINCT p, p FROM near UNION SELECT near.q, lab.m FROM lab JOIN near ON near.p = lab.p WHERE lab.m < near.q"),
    "blk": ("blk(src, dst, block_src, block_dst)", ("lab",), "SELECT p // 2147483648, p % 2147483648, min(m) // 2147483648, min(m) % 2147483648 FROM lab GROUP BY p"),
    "art": ("art(v)", ("cls",), "SELECT x FROM cls GROUP BY x HAVING count(DISTINCT t) > 1"),
    "cut": ("cut(src, dst, v)", ("sym",), "SELECT src, dst, src FROM e UNION SELECT cut.src, cut.dst, sym.b FROM cut JOIN sym ON sym.a = cut.v WHERE NOT (sym.a = cut.src AND sym.b = cut.dst) AND NOT (sym.a = cut.dst AND sym.b = cut.src)"),
    "over": ("over(v, parent, over)", ("nt", "anc"), """SELECT tree.v, tree.parent, coalesce(n, 0) FROM tree LEFT JOIN (SELECT a, count(*) AS n FROM (SELECT src, dst, a FROM (SELECT src, dst, a FROM nt JOIN anc ON v = src
        UNION ALL SELECT src, dst, a FROM nt JOIN anc ON v = dst) GROUP BY src, dst, a HAVING count(*) = 1) GROUP BY a) x ON x.a = tree.v WHERE tree.parent IS NOT NULL"""),
    "bri": ("bri(src, dst)", ("cut",), "SELECT src, dst FROM e EXCEPT SELECT src, dst FROM cut WHERE v = dst"),
}
STEPS["cc"] = (STEPS["cc"][0], ("cc0",), STEPS["cc"][2])
STEPS["lev"] = (STEPS["lev"][0], ("lev0",), STEPS["lev"][2])
STEPS["anc"] = (STEPS["anc"][0], ("anc0",), STEPS["anc"][2])
STEPS["pre"] = (STEPS["pre"][0], ("paths",), STEPS["pre"][2])
STEPS["blv"] = ("blv(block_src, block_dst, head, low)", ("blk", "lev"), """SELECT block_src, block_dst, arg_min(u, level), min(u) FILTER (k > 1) FROM (
        SELECT block_src, block_dst, u, level, row_number() OVER (PARTITION BY block_src, block_dst ORDER BY level) AS k
        FROM (SELECT DISTINCT block_src, block_dst, unnest([src, dst]) AS u FROM blk) JOIN lev ON lev.v = u) GROUP BY ALL""")


def sql(body: str, *needs: str, edges: str = MAIN, extra: str = "") -> str:
    """The query ``body`` over the steps it needs and all that these need."""
    order: list[str] = []

    def add(step: str) -> None:
        if step not in order:
            for n in STEPS[step][1]:
                add(n)
            order.append(step)

    for n in needs:
        add(n)
    parts = [f"e(src, dst) AS ({edges})", *([extra] if extra else []), *[f"{STEPS[n][0]} AS ({STEPS[n][2]})" for n in order]]
    return f"WITH RECURSIVE {', '.join(parts)} {body}"


RING = f"""SELECT DISTINCT least(s, d) AS src, greatest(s, d) AS dst FROM (SELECT id AS s, (id + 1) % 60 AS d FROM range(60) t(id)
    UNION ALL SELECT id, {hash32_sql("'c'", "'q'", "id")} % 60 FROM range(60) t(id) WHERE {hash32_sql("'c'", "'p'", "id")} % 4 = 0) WHERE s <> d"""
UNIFORM = f"""SELECT DISTINCT least(s, d) AS src, greatest(s, d) AS dst FROM (SELECT {hash32_sql("'u'", "'s'", "id")} % 500 AS s, {hash32_sql("'u'", "'d'", "id")} % 500 AS d FROM range(2000) t(id)) WHERE s <> d"""
LONG = f"""SELECT DISTINCT least(s, d) AS src, greatest(s, d) AS dst FROM (SELECT id - 1 AS s, id AS d FROM range(1, 400) t(id)
    UNION ALL SELECT id - 1 - {hash32_sql("'h'", "id", "k")} % 5, id FROM range(1, 400) t(id), range(1, 3) u(k)) WHERE s >= 0 AND s <> d"""
RMAT = f"""SELECT DISTINCT least(s, d) AS src, greatest(s, d) AS dst FROM (SELECT id, CAST(sum(down * (1 << (7 - level))) AS BIGINT) AS s, CAST(sum(rgt * (1 << (7 - level))) AS BIGINT) AS d FROM (
    SELECT id, level, CASE WHEN u >= pa + pb THEN 1 ELSE 0 END AS down, CASE WHEN (u >= pa AND u < pa + pb) OR u >= pa + pb + pc THEN 1 ELSE 0 END AS rgt FROM (
    SELECT id, level, u, CAST(0.45 AS DOUBLE) * (1 + shift) AS pa, CAST(0.15 AS DOUBLE) * (1 - shift) AS pb, CAST(0.15 AS DOUBLE) * (1 - shift) AS pc FROM (
    SELECT id, level, {hash32_sql("'r'", "level", "id")} / CAST(4294967296 AS DOUBLE) AS u, ({hash32_sql("'r'", "'n'", "level", "id")} % 1001 - 500) / CAST(10000 AS DOUBLE) AS shift
    FROM range(2000) t(id), range(8) l(level)))) GROUP BY id) WHERE s <> d"""
_END = "least(({c} % 25) * 12 + CAST(floor(pow(CAST(13 AS DOUBLE), {u} / CAST(4294967296 AS DOUBLE)) - 1) AS BIGINT), 299)"
BLOCK_MODEL = f"""SELECT DISTINCT least(s, d) AS src, greatest(s, d) AS dst FROM (SELECT v AS s, w AS d FROM range(300) t(v), range(300) u(w) WHERE v < w AND v // 12 = w // 12 AND {hash32_sql("'b'", "v", "w")} < 2147483648
    UNION ALL SELECT {_END.format(c=hash32_sql("'b'", "'s'", "'c'", "id"), u=hash32_sql("'b'", "'s'", "id"))}, {_END.format(c=hash32_sql("'b'", "'d'", "'c'", "id"), u=hash32_sql("'b'", "'d'", "id"))} FROM range(300) t(id)) WHERE s <> d"""
def quads(side: int, chains: int, links: int) -> str:
    """The quads of the generated mesh: a grid, and chains of quads that hang by a corner."""
    w = side + 1
    return f"""quads(q, n1, n2, n3, n4) AS (SELECT id, n1, n1 + 1, n1 + {w + 1}, n1 + {w} FROM (SELECT id, (id // {side}) * {w} + id % {side} AS n1 FROM range({side * side}) t(id))
    UNION ALL SELECT id + {side * side}, CASE WHEN id % {links} = 0 THEN (id // {links}) * {side} // {chains} ELSE {w * w} + id * 3 - 2 END, {w * w} + id * 3, {w * w + 1} + id * 3, {w * w + 2} + id * 3 FROM range({chains * links}) t(id))"""


SIDES = "SELECT q, n1 AS s, n2 AS d FROM quads UNION ALL SELECT q, n2, n3 FROM quads UNION ALL SELECT q, n3, n4 FROM quads UNION ALL SELECT q, n4, n1 FROM quads"
QUADS = quads(20, 5, 4)
GROUND = "ground(v) AS (SELECT id FROM range(441) t(id) UNION ALL SELECT (id * 4 + 3) * 3 + 442 FROM range(5) t(id) WHERE id % 2 = 0)"
MESH = f"SELECT DISTINCT least(s, d) AS src, greatest(s, d) AS dst FROM (WITH {QUADS} {SIDES})"
STATUS = """tied(a, b) AS (SELECT a, b FROM sym UNION ALL SELECT -1, v FROM ground UNION ALL SELECT v, -1 FROM ground),
    lost(x, v) AS (SELECT x.v, CAST(-1 AS BIGINT) FROM (SELECT v FROM vtx UNION ALL SELECT -2) x UNION SELECT lost.x, tied.b FROM lost JOIN tied ON tied.a = lost.v WHERE tied.b <> lost.x),
    own(x, v) AS (SELECT v, CAST(-1 AS BIGINT) FROM ground UNION SELECT own.x, tied.b FROM own JOIN tied ON tied.a = own.v WHERE NOT (tied.a = -1 AND tied.b = own.x)),
    status(v, status) AS (SELECT v, CASE WHEN v NOT IN (SELECT v FROM lost WHERE x = -2) THEN 'floating'
        WHEN (SELECT count(*) FROM lost WHERE lost.v = vtx.v) = (SELECT count(*) FROM vtx) AND (v NOT IN (SELECT v FROM ground) OR v IN (SELECT v FROM own WHERE own.x = own.v)) THEN 'kept' ELSE 'hinged' END FROM vtx)"""


def with_status(body: str) -> str:
    return sql("", "vtx", edges=MESH, extra=GROUND) + f", {STATUS} {body}"


_POINT_COUNTS = "SELECT (SELECT count(*) FROM art) AS articulation_points, count(*) AS blocks, count(*) FILTER (edges = 1) AS bridges, coalesce(max(edges), 0) AS largest_block FROM (SELECT count(*) AS edges FROM blk GROUP BY block_src, block_dst)"
_CUSTOMER_SIZES = "SELECT max(v) AS component, count(*) AS size FROM cc GROUP BY c"

ORACLE_SQL: dict[str, str] = {
    "degrees": sql("SELECT v, degree FROM deg", "deg"),
    "degree_stats": sql("SELECT count(*) AS n, CAST(sum(degree) / 2 AS BIGINT) AS m, max(degree) AS max_degree, avg(degree) AS avg_degree FROM deg", "deg"),
    "max_degree_root": sql("SELECT v, degree FROM deg ORDER BY degree DESC, v LIMIT 1", "deg"),
    "adjacency_rows": sql("SELECT a AS v, count(*) AS degree, min(b) AS first, max(b) AS last FROM sym GROUP BY a", "sym"),
    "edge_balanced_partition": sql("SELECT v, CAST(least(floor(coalesce(sum(degree) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 8 / (SELECT sum(degree) FROM deg)), 7) AS BIGINT) AS part FROM deg", "deg"),
    "edges_by_part": sql("""SELECT part, count(*) AS ends, count(DISTINCT a) AS vertices FROM sym JOIN (SELECT v, CAST(least(floor(coalesce(sum(degree) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 8
        / (SELECT sum(degree) FROM deg)), 7) AS BIGINT) AS part FROM deg) ON v = a GROUP BY part""", "deg"),
    "neighbour_degrees": sql("SELECT a AS v, b AS neighbour, degree FROM sym JOIN deg ON deg.v = b", "deg"),
    "spread_ids": sql("SELECT v, (v % 16) * 65537 + v // 16 AS id FROM vtx", "vtx"),
    "components": sql("SELECT v, c AS component FROM cc", "cc"),
    "components_max_label": sql("SELECT v, max(v) OVER (PARTITION BY c) AS component FROM cc", "cc", edges=TURNS),
    "component_stats": sql("SELECT count(*) AS components, max(n) AS largest, count(*) FILTER (n > 1) AS nontrivial FROM (SELECT count(*) AS n FROM cc GROUP BY c)", "cc", edges=TURNS),
    "largest_component": sql(f"{_CUSTOMER_SIZES} ORDER BY size DESC, component DESC LIMIT 1", "cc", edges=TURNS),
    "largest_component_edges": sql(f"SELECT src, dst FROM e JOIN cc ON v = src WHERE c = (SELECT c FROM (SELECT c, max(v) AS component, count(*) AS size FROM cc GROUP BY c) ORDER BY size DESC, component DESC LIMIT 1)", "cc", edges=TURNS),
    "largest_component_relabelled": sql("""SELECT x.id AS src, y.id AS dst FROM e JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS id FROM cc WHERE c = (SELECT c FROM (SELECT c, max(v) AS m, count(*) AS n FROM cc GROUP BY c) ORDER BY n DESC, m DESC LIMIT 1)) x ON x.v = src
        JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS id FROM cc WHERE c = (SELECT c FROM (SELECT c, max(v) AS m, count(*) AS n FROM cc GROUP BY c) ORDER BY n DESC, m DESC LIMIT 1)) y ON y.v = dst""", "cc"),
    "component_of_vertex": sql("SELECT v FROM cc WHERE c = (SELECT c FROM cc WHERE v = 2)", "cc", edges=PLACES),
    "wrong_components": sql("SELECT src, dst FROM e JOIN cc x ON x.v = src JOIN cc y ON y.v = dst WHERE x.c <> y.c", "cc"),
    "bfs_tree": sql("SELECT v, coalesce(parent, v) AS parent, level, root FROM tree", "tree"),
    "bfs_levels": sql("SELECT level, count(*) AS n, min(v) AS first, max(v) AS last FROM lev GROUP BY level", "lev"),
    "bfs_tree_places": sql("SELECT v, coalesce(parent, v) AS parent, level, root FROM tree", "tree", edges=PLACES),
    "bottom_up_step": sql("SELECT v, parent FROM tree WHERE level = 2", "tree"),
    "bad_tree_rows": sql("SELECT v, parent, level FROM tree WHERE level < 0", "tree"),
    "children_rank": sql("""SELECT v, coalesce(parent, v) AS parent, CASE WHEN parent IS NOT NULL THEN row_number() OVER (PARTITION BY parent ORDER BY v) - 1 ELSE 0 END AS rank, (SELECT count(*) FROM tree k WHERE k.parent = tree.v) AS children FROM tree""", "tree"),
    "descendants": sql("SELECT v, n_desc FROM nd", "nd"),
    "preorder": sql("SELECT v, pre FROM pre", "pre"),
    "preorder_euler": sql("SELECT v, pre FROM pre", "pre"),
    "low_high": sql("SELECT v, low, high FROM lh", "lh"),
    "related_ends": sql("SELECT x.v IS NOT NULL OR y.v IS NOT NULL AS related, count(*) AS edges FROM e LEFT JOIN anc x ON x.v = src AND x.a = dst LEFT JOIN anc y ON y.v = dst AND y.a = src GROUP BY 1", "anc"),
    "lca_nontree": sql("SELECT src, dst, lca FROM lca", "lca"),
    "tree_edge_marks": sql("SELECT v, parent, over FROM over", "over"),
    "bridges_by_marks": sql("SELECT src, dst FROM bri", "bri"),
    "bridges": sql("SELECT src, dst FROM bri", "bri"),
    "candidate_articulation": sql("SELECT lca AS v FROM lca UNION SELECT src FROM bri UNION SELECT dst FROM bri", "lca", "bri"),
    "candidates_compared": sql("""SELECT count(*) FILTER (f AND k) AS correct, count(*) FILTER (NOT k) AS false_positive, count(*) FILTER (NOT f) AS false_negative FROM (SELECT x.v IS NOT NULL AS f, art.v IS NOT NULL AS k
        FROM (SELECT lca AS v FROM lca UNION SELECT src FROM bri UNION SELECT dst FROM bri) x FULL JOIN art ON art.v = x.v)""", "lca", "bri", "art"),
    "articulation_points": sql("SELECT v FROM art", "art"),
    "articulation_by_labels": sql("SELECT v FROM art", "art"),
    "edge_blocks": sql("SELECT * FROM blk", "blk"),
    "edge_blocks_on_certificate": sql("SELECT * FROM blk", "blk"),
    "vertex_labels": sql("SELECT tree.v, head AS high, low FROM tree JOIN blk ON src = least(tree.v, parent) AND dst = greatest(tree.v, parent) JOIN blv USING (block_src, block_dst)", "tree", "blv"),
    "edge_labels_from_vertices": sql("SELECT src, dst, head, low FROM blk JOIN blv USING (block_src, block_dst)", "blv"),
    "unlabelled_vertices": sql("SELECT v FROM vtx WHERE v NOT IN (SELECT a FROM sym)", "vtx"),
    "block_sizes": sql("SELECT block_src, block_dst, count(*) AS edges FROM blk GROUP BY ALL", "blk"),
    "bcc_counts": sql(_POINT_COUNTS, "blk", "art"),
    "bcc_counts_places": sql("SELECT (SELECT count(*) FROM deg WHERE degree > 1) AS articulation_points, count(*) AS blocks, count(*) AS bridges, CAST(1 AS BIGINT) AS largest_block FROM e", "deg", edges=PLACES),
    "largest_block": sql("SELECT src, dst FROM blk SEMI JOIN (SELECT block_src, block_dst, count(*) AS n FROM blk GROUP BY ALL ORDER BY n DESC, block_src, block_dst LIMIT 1) USING (block_src, block_dst)", "blk"),
    "block_of_root_edge": sql("""SELECT src, dst FROM blk SEMI JOIN (SELECT block_src, block_dst FROM blk JOIN (SELECT v FROM deg ORDER BY degree DESC, v LIMIT 1) r ON v IN (src, dst)
        ORDER BY CASE WHEN src = v THEN dst ELSE src END LIMIT 1) USING (block_src, block_dst)""", "blk", "deg"),
    "nontree_components": sql("", "nt").rstrip() + """, ns(a, b) AS (SELECT src, dst FROM nt UNION ALL SELECT dst, src FROM nt), nc(v, c) AS (SELECT DISTINCT a, a FROM ns UNION SELECT ns.b, nc.c FROM nc JOIN ns ON ns.a = nc.v WHERE nc.c < ns.b)
        SELECT v, min(c) AS component FROM nc GROUP BY v""",
}
#: Steps of the forest of the non-tree edges, from the smallest vertex of each component.
SECOND = """, ns(a, b) AS (SELECT src, dst FROM nt UNION ALL SELECT dst, src FROM nt), nc(v, c) AS (SELECT DISTINCT a, a FROM ns UNION SELECT ns.b, nc.c FROM nc JOIN ns ON ns.a = nc.v WHERE nc.c < ns.b),
    nl0(v, level) AS (SELECT DISTINCT min(c), CAST(0 AS BIGINT) FROM nc GROUP BY v UNION SELECT ns.b, level + 1 FROM nl0 JOIN ns ON ns.a = nl0.v WHERE level < 60), nl(v, level) AS (SELECT v, min(level) FROM nl0 GROUP BY v),
    nf(v, parent, level) AS (SELECT nl.v, (SELECT min(b) FROM ns JOIN nl l2 ON l2.v = ns.b WHERE ns.a = nl.v AND l2.level = nl.level - 1), nl.level FROM nl),
    fe(src, dst) AS (SELECT least(v, parent), greatest(v, parent) FROM nf WHERE parent IS NOT NULL)"""
THIRD = SECOND.replace("FROM nt", "FROM n2").replace("ns(", "ms(").replace("ns ", "ms ").replace("ns.", "ms.").replace("nc", "mc").replace("nl", "ml").replace("nf", "mf").replace("fe(", "ge(")
ORACLE_SQL |= {
    "spanning_forest_nontree": sql("", "nt").rstrip() + SECOND + " SELECT v, coalesce(parent, v) AS parent, level FROM nf",
    "certificate": sql("", "nt").rstrip() + SECOND + " SELECT src, dst, CAST(0 AS BIGINT) AS forest FROM te UNION ALL SELECT src, dst, 1 FROM fe",
    "certificate_dense": sql("", "nt", edges=DENSE).rstrip() + """, ns(a, b) AS (SELECT src, dst FROM nt UNION ALL SELECT dst, src FROM nt), nc(v, c) AS (SELECT DISTINCT a, a FROM ns UNION SELECT ns.b, nc.c FROM nc JOIN ns ON ns.a = nc.v WHERE nc.c < ns.b)
        SELECT CAST(0 AS BIGINT) AS forest, count(*) AS edges FROM te UNION ALL SELECT 1, count(*) - count(DISTINCT c) FROM (SELECT v, min(c) AS c FROM nc GROUP BY v)""",
    "articulation_on_certificate": sql("SELECT v FROM art", "art"),
    "k_forests": sql("", "nt").rstrip() + SECOND + ", n2(src, dst) AS (SELECT src, dst FROM nt EXCEPT SELECT src, dst FROM fe)" + THIRD
    + " SELECT src, dst, CAST(0 AS BIGINT) AS forest FROM te UNION ALL SELECT src, dst, 1 FROM fe UNION ALL SELECT src, dst, 2 FROM ge",
    "degree2_separators": sql("SELECT a AS v, min(b) AS a, max(b) AS b FROM sym GROUP BY sym.a HAVING count(*) = 2", "sym"),
    "separation_pairs": sql("", "blk").rstrip() + """, lb AS (SELECT src, dst FROM blk SEMI JOIN (SELECT block_src, block_dst, count(*) AS n FROM blk GROUP BY ALL ORDER BY n DESC, block_src, block_dst LIMIT 1) USING (block_src, block_dst)),
        ls(a, b) AS (SELECT src, dst FROM lb UNION ALL SELECT dst, src FROM lb), lv(v) AS (SELECT DISTINCT a FROM ls), pr(a, b) AS (SELECT x.v, y.v FROM lv x JOIN lv y ON x.v < y.v),
        rc(a, b, v) AS (SELECT a, b, (SELECT min(v) FROM lv WHERE v <> pr.a AND v <> pr.b) FROM pr UNION SELECT rc.a, rc.b, ls.b FROM rc JOIN ls ON ls.a = rc.v WHERE ls.b <> rc.a AND ls.b <> rc.b)
        SELECT a, b FROM rc GROUP BY a, b HAVING count(*) < (SELECT count(*) - 2 FROM lv)""",
    "grid_mesh_edges": MESH,
    "boundary_nodes": sql("SELECT v FROM deg WHERE degree > 2", "deg"),
    "ground_sensitivity": f"""WITH {QUADS}, {GROUND}, corner AS (SELECT q, unnest([n1, n2, n3, n4]) AS v FROM quads), hit AS (SELECT q, v FROM corner SEMI JOIN ground USING (v))
        SELECT DISTINCT v FROM hit WHERE q IN (SELECT q FROM hit GROUP BY q HAVING count(*) >= 3)""",
    "file_text_header": sql("SELECT src, dst FROM e"),
    "file_text_edges": sql("SELECT src, dst FROM e"),
    "file_packed_edges": sql("SELECT src, dst FROM e"),
    "file_packed_wide": sql("SELECT src, dst FROM e"),
    "file_text_adjacency": sql("SELECT x.id AS src, y.id AS dst FROM sym JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS id FROM vtx) x ON x.v = a JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS id FROM vtx) y ON y.v = b", "vtx"),
    "file_binary_adjacency": sql("SELECT x.id AS src, y.id AS dst FROM sym JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS id FROM vtx) x ON x.v = a JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS id FROM vtx) y ON y.v = b", "vtx"),
    "file_converted": sql("SELECT least(x.id, y.id) AS src, greatest(x.id, y.id) AS dst FROM e JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS id FROM vtx) x ON x.v = src JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS id FROM vtx) y ON y.v = dst", "vtx"),
    "file_vertex_parts": sql("SELECT row_number() OVER (ORDER BY v) - 1 AS v, CAST(least(floor(coalesce(sum(degree) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 8 / (SELECT sum(degree) FROM deg)), 7) AS BIGINT) AS part FROM deg", "deg"),
    "file_distribution": sql("SELECT degree AS d, count(*) AS nd, CAST(1 AS DOUBLE) / (1 + degree) AS cd FROM deg GROUP BY degree", "deg"),
    "file_certificate": sql("", "nt").rstrip() + SECOND + " SELECT src, dst FROM te UNION ALL SELECT src, dst FROM fe",
    "file_points": sql("SELECT v FROM art", "art"),
    "file_labels": sql("SELECT v, c AS component FROM cc", "cc"),
    "file_mesh": sql("SELECT 'quad side' AS kind, src, dst FROM e UNION ALL SELECT 'border', src, dst FROM e UNION ALL SELECT 'grounded', v, CAST(-1 AS BIGINT) FROM ground UNION ALL SELECT 'boundary', v, CAST(-1 AS BIGINT) FROM deg WHERE degree > 2", "deg", edges=MESH, extra=GROUND),
    "edge_blocks_deep": sql("SELECT * FROM blk", "blk"),
    "edge_blocks_mesh": f"""WITH {quads(100, 10, 20)}, side AS ({SIDES}), own AS (SELECT DISTINCT least(s, d) AS src, greatest(s, d) AS dst, CASE WHEN q < 10000 THEN -1 ELSE q END AS part FROM side)
        SELECT src, dst, min(src) OVER (PARTITION BY part) AS block_src, CAST(arg_min(dst, src * 100000 + dst) OVER (PARTITION BY part) AS BIGINT) AS block_dst FROM own""",
    "without_islands": ORACLE_SQL["largest_component_edges"],
    "ice_status": with_status("SELECT v, status FROM status"),
    "ice_removed": with_status("SELECT v + 1 AS node FROM status WHERE status <> 'kept'"),
    "gen_uniform": UNIFORM,
    "gen_rmat": RMAT,
    "gen_high_diameter": LONG,
    "gen_ring": RING,
    "gen_block_model": BLOCK_MODEL,
}
ORACLE_SQL["partition_by_starts"] = ORACLE_SQL["edge_balanced_partition"]
#: The same questions of all line items, where the steps above answer them in seconds at scale 0.01. Blocks, cut vertices and bridges of the
#: whole part-supplier graph take these steps too long; tests compare them with a depth-first search.
WHOLE = """degrees degree_stats max_degree_root adjacency_rows edge_balanced_partition edges_by_part spread_ids components components_max_label
component_stats largest_component largest_component_edges largest_component_relabelled wrong_components bfs_tree bfs_levels bottom_up_step bad_tree_rows
children_rank descendants preorder preorder_euler low_high related_ends lca_nontree unlabelled_vertices nontree_components spanning_forest_nontree
certificate k_forests boundary_nodes neighbour_degrees partition_by_starts tree_edge_marks""".split()
ORACLE_SQL |= {f"{name}_whole": ORACLE_SQL[name].replace(MAIN, DENSE).replace(TURNS, CUSTOMER_PART) for name in WHOLE}
#: Bridges as tree edges that no path of another edge goes over.
ORACLE_SQL |= {f"{name}_whole": sql("SELECT least(v, parent) AS src, greatest(v, parent) AS dst FROM over WHERE over = 0", "over", edges=DENSE) for name in ("bridges", "bridges_by_marks")}
#: A conversation of one turn is a vertex without edges.
ORACLE_SQL |= {name: ORACLE_SQL[name].replace(STEPS["vtx"][2], TURN_IDS) for name in ("components_max_label", "component_stats", "largest_component", "largest_component_edges", "without_islands")}
