"""Registered queries: cutting units and symbol context."""

from pyspark.sql import functions as F

from judgelake.operators import packaging as P
from judgelake.operators import units as U
from judgelake.plans import views as V
from judgelake.plans.queries_packaging import CLUSTER_SQL, _changes, code_lines, members
from judgelake.plans.registry import query
from judgelake.session import cut_lineage, written

# Symbols follow the code lines: every tenth line opens a top-level symbol of eight
# lines with a method of four inside; a third of the old names differ.
SYMBOLS_SQL = """
SELECT file, side, CASE WHEN side = 'before' AND (doc_id + i) % 3 = 0 THEN 'old' ELSE 'fn' END || (i // 10) AS name, CAST(i + 1 AS INTEGER) AS start, CAST(i + 8 AS INTEGER) AS "end", 0 AS depth
FROM v_code, (SELECT unnest(['before', 'after']) AS side) WHERE i % 10 = 0 AND doc_id % 13 <> 1
UNION ALL SELECT file, side, 'm' || (i // 10), CAST(i AS INTEGER), CAST(i + 3 AS INTEGER), 1 FROM v_code, (SELECT unnest(['before', 'after']) AS side) WHERE i % 10 = 3 AND doc_id % 13 <> 1
"""
V.VIEWS_SQL["v_symbols"] = (("v_code",), SYMBOLS_SQL)


def symbols(spark, sf):
    c = code_lines(spark, sf).filter("doc_id % 13 <> 1").withColumn("side", F.explode(F.array(F.lit("before"), F.lit("after"))))
    n = F.floor(F.col("i") / 10).cast("string")
    top = c.filter("i % 10 = 0").select("file", "side", F.concat(F.when((F.col("side") == "before") & ((F.col("doc_id") + F.col("i")) % 3 == 0), "old").otherwise("fn"), n).alias("name"),
                                        (F.col("i") + 1).alias("start"), (F.col("i") + 8).alias("end"), F.lit(0).alias("depth"))
    inner = c.filter("i % 10 = 3").select("file", "side", F.concat(F.lit("m"), n).alias("name"), F.col("i").alias("start"), (F.col("i") + 3).alias("end"), F.lit(1).alias("depth"))
    return top.unionByName(inner)


def file_entries(spark, sf):
    """Whole files as units; every ninth line is blank."""
    e = cut_lineage(P.parse_diff(_changes(spark, sf)))
    return e.withColumnRenamed("change_id", "unit_id").withColumn("text", F.when((F.col("unit_id") + F.col("head_line")) % 9 == 4, "  ").otherwise(F.col("text")))


def cluster_entries(spark, sf):
    m = members(spark, sf)
    return m.withColumn("unit_id", F.concat_ws(":", *[F.col(c).cast("string") for c in ("change_id", "hunk_no", "run")]))


LISTS = """
ent AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS idx, i, kind, head_line, CASE WHEN kind = '-' THEN old_line ELSE new_line END AS line, (doc_id + head_line) % 9 = 4 AS blank, text FROM v_parsed),
lst AS (SELECT doc_id, list(line ORDER BY idx) AS l, list(coalesce(blank, FALSE) OR regexp_matches(text, '^\\s*$') ORDER BY idx) AS b, list(kind ORDER BY idx) AS k, count(*) AS n FROM ent GROUP BY doc_id)"""
WINDOWS = LISTS + """,
walk(doc_id, i, f, s, cuts) AS (SELECT doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(l[1] AS BIGINT), [CAST(0 AS BIGINT)] FROM lst UNION ALL
  SELECT doc_id, i, CASE WHEN full_ THEN cut ELSE f END, CASE WHEN full_ THEN CASE WHEN cut < i THEN l[cut + 1] END ELSE s END, CASE WHEN full_ THEN list_append(cuts, cut) ELSE cuts END FROM (
    SELECT *, CASE WHEN last IS NOT NULL AND l[last + 1] - s + 1 <= 20 THEN last + 1 ELSE i END AS cut FROM (
      SELECT *, list_max(list_filter(range(f + 1, i), lambda j: b[j + 1] OR l[j + 1] - s + 1 > 20)) AS last FROM (
        SELECT w.doc_id, w.i + 1 AS i, w.f, coalesce(w.s, t.l[w.i + 2]) AS s, w.cuts, t.l, t.b, w.i + 1 > w.f AND t.l[w.i + 2] - coalesce(w.s, t.l[w.i + 2]) + 1 > 20 AS full_
        FROM walk w JOIN lst t USING (doc_id) WHERE w.i + 1 < t.n)))),
fin AS (SELECT w.doc_id, cuts, t.k, t.n FROM walk w JOIN lst t USING (doc_id) WHERE w.i = t.n - 1),
heads AS (SELECT doc_id, list_filter(cuts, lambda c, g: c = 0 OR len(list_filter(k[c + 1:CASE WHEN g = len(cuts) THEN n ELSE cuts[g + 1] END], lambda x: x <> ' ')) > 0) AS hs, k FROM fin)"""


@query("c15_line_windows", V.sql_with("v_parsed", "WITH " + WINDOWS.strip() + """
SELECT e.doc_id AS unit_id, e.kind, e.head_line, e.line, CAST(len(list_filter(hs, lambda h: h <= e.idx)) AS INTEGER) AS win FROM ent e JOIN heads h USING (doc_id)
WHERE len(hs) > 1 AND len(list_filter(h.k, lambda x: x <> ' ')) > 0""", recursive=True))
def c15(spark, sf):
    e = file_entries(spark, sf)
    return e.join(U.line_windows(e, 20), ["unit_id", "pos"]).select("unit_id", "kind", "head_line", U.own_line(F.col("kind")).alias("line"), "win")


@query("c16_size_routes", V.sql_with("v_parsed", "WITH " + CLUSTER_SQL.strip() + " SELECT change_id, line, n_changed, size, size * 200 / 3e0 > 900 AS oversize, NOT size * 200 / 3e0 > 900 AND line_end - line_start + 1 > 9 AS band FROM cl"))
def c16(spark, sf):
    u = P.clusters(members(spark, sf)).withColumn("tokens", F.col("size") * 200 / F.lit(3.0))
    return U.size_routes(u, 900, 9).select("change_id", "line", "n_changed", "size", "oversize", "band")


@query("c17_symbol_cut")
def c17(spark, sf):
    e = file_entries(spark, sf)
    return U.sub_units(e.join(U.symbol_cut(e, symbols(spark, sf)), ["unit_id", "pos"]), "part")


def _sites(spark, sf):
    s = cut_lineage(symbols(spark, sf).filter("side = 'after'"))
    return s.select("file", F.concat_ws(":", "name", F.col("start").cast("string"), F.col("depth").cast("string")).alias("site_id"), "start", "end", "depth")


@query("c18_leafmost_sites", V.sql_with("v_parsed v_symbols", """
WITH ln AS (SELECT DISTINCT doc_id, file, CASE WHEN kind = '-' THEN old_line ELSE new_line END AS "at" FROM v_parsed WHERE kind <> ' ')
SELECT doc_id AS unit_id, "at", name || ':' || start || ':' || depth AS site_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, "at" ORDER BY depth DESC, "end" - start, start) AS r
  FROM ln JOIN v_symbols s ON s.file = ln.file AND side = 'after' AND "at" BETWEEN start AND "end") WHERE r = 1"""))
def c18(spark, sf):
    return U.leafmost_sites(file_entries(spark, sf), _sites(spark, sf))


def _settle_sql(floor, rounds=5, jumps=4):
    """Rounds of merging over ``g0`` (u, name, lo, hi), written out; ends in ``hosts`` (u, name, part)."""
    parts = ["h0 AS MATERIALIZED (SELECT u, name, name AS part FROM g0)"]
    for k in range(rounds):
        parts.append(f"""n{k} AS MATERIALIZED (SELECT u, name, lo, hi, row_number() OVER (PARTITION BY u ORDER BY lo, hi, name) AS place FROM g{k}),
t{k} AS MATERIALIZED (SELECT a.u, a.place, coalesce(arg_min(b.place, least(abs(b.lo - a.lo), abs(b.hi - a.hi)) * 1000000 + b.place), a.place) AS dest
  FROM n{k} a LEFT JOIN n{k} b ON a.u = b.u AND a.place <> b.place AND a.hi - a.lo + 1 < {floor} GROUP BY a.u, a.place),
j{k}_0 AS MATERIALIZED (SELECT a.u, a.place, CASE WHEN b.dest = a.place AND a.place < a.dest THEN a.place ELSE a.dest END AS dest FROM t{k} a JOIN t{k} b ON a.u = b.u AND b.place = a.dest)""")
        parts += [f"j{k}_{i + 1} AS MATERIALIZED (SELECT a.u, a.place, b.dest FROM j{k}_{i} a JOIN j{k}_{i} b ON a.u = b.u AND b.place = a.dest)" for i in range(jumps)]
        parts.append(f"""m{k} AS MATERIALIZED (SELECT n.u, n.name, n.lo, n.hi, r.name AS part FROM n{k} n JOIN j{k}_{jumps} j ON j.u = n.u AND j.place = n.place JOIN n{k} r ON r.u = n.u AND r.place = j.dest),
g{k + 1} AS MATERIALIZED (SELECT u, part AS name, min(lo) AS lo, max(hi) AS hi FROM m{k} GROUP BY u, part),
h{k + 1} AS MATERIALIZED (SELECT h.u, h.name, m.part FROM h{k} h JOIN m{k} m ON m.u = h.u AND m.name = h.part)""")
    parts.append(f"hosts AS MATERIALIZED (SELECT * FROM h{rounds} WHERE u IN (SELECT u FROM h{rounds} GROUP BY u HAVING count(DISTINCT part) > 1))")
    return ",\n".join(parts)


# Units ``ent`` (u, file, i, kind, at, head_line, new_line, hunk_start) with their sites; the groups before merging are ``g0``.
OWNERS = """
ln AS (SELECT DISTINCT u, file, "at" FROM ent WHERE kind <> ' '),
lead AS (SELECT u, "at", name || ':' || start || ':' || depth AS site FROM (SELECT *, row_number() OVER (PARTITION BY u, "at" ORDER BY depth DESC, "end" - start, start) AS r
  FROM ln JOIN v_symbols s ON s.file = ln.file AND side = 'after' AND "at" BETWEEN start AND "end") WHERE r = 1),
cuts AS (SELECT u FROM lead GROUP BY u HAVING count(DISTINCT site) > 1 INTERSECT SELECT u FROM ent WHERE kind = '+'),
own AS (SELECT e.*, site FROM ent e LEFT JOIN lead l ON l.u = e.u AND l."at" = e."at" WHERE e.u IN (SELECT u FROM cuts)),
held AS (SELECT DISTINCT u, site, start, "end" FROM own JOIN v_symbols s ON s.file = own.file AND side = 'after' AND site = name || ':' || start || ':' || depth),
glue AS (SELECT u, i, site FROM (SELECT o.u, o.i, h.site, row_number() OVER (PARTITION BY o.u, o.i ORDER BY least(abs(start - o."at"), abs("end" - o."at")), start, h.site) AS r
  FROM own o JOIN held h ON h.u = o.u WHERE o.site IS NULL) WHERE r = 1),
owned AS MATERIALIZED (SELECT o.* EXCLUDE (site), coalesce(o.site, g.site) AS site FROM own o LEFT JOIN glue g ON g.u = o.u AND g.i = o.i),
g0 AS MATERIALIZED (SELECT u, site AS name, min("at") AS lo, max("at") AS hi FROM owned GROUP BY u, site)"""


@query("c19_site_parts", V.sql_with("v_parsed v_symbols", """
WITH ent AS (SELECT doc_id AS u, file, i, kind, CASE WHEN kind = '-' THEN old_line ELSE new_line END AS "at", head_line, new_line, hunk_start FROM v_parsed),""" + OWNERS + ",\n" + _settle_sql(16) + """
SELECT o.u AS unit_id, part, CAST(coalesce(arg_min(new_line, i) FILTER (WHERE kind = '+'), arg_min(head_line, i) FILTER (WHERE kind = '-'), min(hunk_start)) AS INTEGER) AS line,
  min(head_line) AS line_start, max(head_line) AS line_end, CAST(count(*) FILTER (WHERE kind <> ' ') AS INTEGER) AS n_changed, CAST(count(*) AS INTEGER) AS size
FROM owned o JOIN hosts h ON h.u = o.u AND h.name = o.site GROUP BY o.u, part"""))
def c19(spark, sf):
    e = file_entries(spark, sf)
    return U.sub_units(e.join(U.site_parts(e, _sites(spark, sf)), ["unit_id", "pos"]).filter("part is not null"), "part")


CENSUS_FLOORS = (2, 4, 8)


def _census_sql():
    spans = [f"""s{f} AS (WITH {_settle_sql(f)}, w AS (SELECT o.u, part, max(head_line) - min(head_line) + 1 AS span FROM owned o JOIN hosts h ON h.u = o.u AND h.name = o.site GROUP BY o.u, part)
  SELECT {f} AS size_floor, span FROM w UNION ALL SELECT {f}, max(head_line) - min(head_line) + 1 FROM ent WHERE u NOT IN (SELECT u FROM w) GROUP BY u)""" for f in CENSUS_FLOORS]
    return ",\n".join(spans)


# Clusters a provider that takes whole clusters keeps; a span of 120 lines is out of reach of the tables.
@query("c28_site_census", V.sql_with("v_parsed v_symbols", "WITH " + CLUSTER_SQL.strip() + f""",
kept AS (SELECT change_id, h, lo FROM cl WHERE size <= 12 AND file NOT LIKE '%.md'),
ent AS MATERIALIZED (SELECT w.doc_id || ':' || w.h || ':' || w.lo AS u, w.file, i, kind, CASE WHEN kind = '-' THEN old_line ELSE new_line END AS "at", head_line FROM win w JOIN kept k ON k.change_id = w.doc_id AND k.h = w.h AND k.lo = w.lo),
{OWNERS.strip()},
{_census_sql()},
a AS ({" UNION ALL ".join(f"SELECT * FROM s{f}" for f in CENSUS_FLOORS)}),
m AS (SELECT size_floor, count(*) AS n_sites, list_sort(list(span))[count(*) // 2 + 1] AS median_span, (SELECT count(DISTINCT u) FROM ent) AS n_clusters FROM a GROUP BY size_floor),
o AS (SELECT *, n_sites / n_clusters AS expansion, CASE WHEN n_sites / n_clusters <= 10 THEN 'pass' WHEN median_span > 120 OR size_floor = {max(CENSUS_FLOORS)} THEN 'fail' END AS outcome FROM m)
SELECT size_floor, n_sites, n_clusters, median_span, round(expansion, 6) AS expansion, outcome, size_floor = min(size_floor) FILTER (WHERE outcome IS NOT NULL) OVER () AS chosen FROM o"""))
def c28(spark, sf):
    e = cluster_entries(spark, sf)
    units = P.kept(P.triage(P.clusters(members(spark, sf)), False, 12)).select("change_id", "hunk_no", "run")
    e = e.join(units, ["change_id", "hunk_no", "run"], "left_semi").select("unit_id", "file", "pos", "kind", "new_line", "old_line", "head_line")
    return U.site_census(cut_lineage(e), _sites(spark, sf), CENSUS_FLOORS).withColumn("expansion", F.round("expansion", 6))


@query("c30_halves", V.sql_with("v_parsed", "WITH " + CLUSTER_SQL.strip() + """,
o AS (SELECT doc_id, h, lo, i, kind, head_line, text, sum(CASE WHEN kind <> ' ' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, h, lo ORDER BY i) AS k, count(*) FILTER (WHERE kind <> ' ') OVER (PARTITION BY doc_id, h, lo) AS n FROM win),
m AS (SELECT *, min(CASE WHEN kind <> ' ' AND k = n // 2 + 1 THEN i END) OVER (PARTITION BY doc_id, h, lo) AS mid, min(i) OVER (PARTITION BY doc_id, h, lo) AS first FROM o)
SELECT doc_id AS change_id, kind, head_line, text, n, CAST(CASE WHEN i < mid THEN 1 ELSE 2 END AS INTEGER) AS half FROM m WHERE first < mid AND (n > 1 OR i >= mid)"""))
def c30(spark, sf):
    e = cluster_entries(spark, sf)
    h = e.join(U.halves(e), ["unit_id", "pos"])
    n = F.col("n")
    counts = e.groupBy("unit_id").agg(F.count_if(F.col("kind") != " ").alias("n"))
    return h.join(counts, "unit_id").select("change_id", "kind", "head_line", "text", n, "half")


def _units(spark, sf):
    m = cut_lineage(members(spark, sf))
    pid = F.concat_ws(":", F.col("change_id").cast("string"), F.col("hunk_no").cast("string"), F.col("run").cast("string"))
    u = cut_lineage(P.clusters(m).withColumn("point_id", pid))
    gone = m.filter("own and kind = '-'").groupBy(pid.alias("point_id")).agg(F.min_by("old_line", "pos").alias("first_old_line"))
    return u, gone


POINTS = "WITH " + CLUSTER_SQL.strip() + """,
pts AS (SELECT cl.change_id, cl.h, cl.lo, cl.file, cl.line, cl.n_changed, cl.change_type, CASE WHEN change_type = 'deletion-only' THEN 'before' WHEN change_type = 'code-change' THEN 'after' END AS side,
  CASE WHEN change_type = 'deletion-only' THEN (SELECT arg_min(w.old_line, w.i) FROM win w WHERE w.doc_id = cl.change_id AND w.h = cl.h AND w.lo = cl.lo AND own AND kind = '-') ELSE line END AS at FROM cl),
enc AS (SELECT change_id, h, lo, string_agg(s.name, '.' ORDER BY depth, start) AS symbol, arg_min(s.start, ("end" - s.start) * 1000000 - s.start) AS nstart, arg_min(s."end", ("end" - s.start) * 1000000 - s.start) AS nend,
  arg_min(s.name, ("end" - s.start) * 1000000 - s.start) AS nname FROM pts p JOIN v_symbols s ON s.file = p.file AND s.side = p.side AND p.at BETWEEN s.start AND s."end" GROUP BY change_id, h, lo)"""


@query("c22_locate", V.sql_with("v_parsed v_symbols", POINTS + " SELECT change_id, line, n_changed, symbol FROM pts LEFT JOIN enc USING (change_id, h, lo)"))
def c22(spark, sf):
    u, gone = _units(spark, sf)
    return U.locate(u, gone, symbols(spark, sf)).join(u.select("point_id", "change_id", "n_changed"), "point_id").select("change_id", "line", "n_changed", "symbol")


def _file_lines(spark, sf):
    """Both images of a file hold its code lines, numbered from one."""
    c = code_lines(spark, sf)
    return c.select("file", F.explode(F.array(F.lit("before"), F.lit("after"))).alias("side"), (F.col("i") + 1).alias("line"), "text")


@query("c23_context_windows", V.sql_with("v_parsed v_symbols v_code", POINTS + """
SELECT change_id, line, n_changed, symbol, coalesce((SELECT string_agg(rtrim(text, ' '), chr(10) ORDER BY i) FROM v_code c WHERE c.file = p.file AND c.i + 1 BETWEEN nstart AND least(nend, nstart + 2)), '') AS context
FROM pts p JOIN enc USING (change_id, h, lo)"""))
def c23(spark, sf):
    u, gone = _units(spark, sf)
    w = U.context_windows(U.lookup_points(u, gone), symbols(spark, sf), _file_lines(spark, sf), n=3)
    return w.join(u.select("point_id", "change_id", "line", "n_changed"), "point_id").select("change_id", "line", "n_changed", "symbol", F.array_join("context", "\n").alias("context"))


@query("c23_symbol_tables", V.sql_with("v_symbols", """
SELECT file, side, string_agg(name, ',' ORDER BY start) AS names FROM (SELECT *, row_number() OVER (PARTITION BY file, side ORDER BY start, name) AS r FROM v_symbols WHERE depth = 0) WHERE r <= 4 GROUP BY file, side"""))
def c23_tables(spark, sf):
    return U.symbol_tables(symbols(spark, sf), 4).select("file", "side", F.array_join("symbols", ",").alias("names"))


@query("c24_enclosing_declaration", V.sql_with("v_parsed v_symbols", POINTS + " SELECT change_id, line, n_changed, coalesce(nname, file || ':<module>') AS declaration FROM pts LEFT JOIN enc USING (change_id, h, lo) WHERE side IS NOT NULL"))
def c24(spark, sf):
    u, gone = _units(spark, sf)
    d = U.enclosing_declaration(U.lookup_points(u, gone), symbols(spark, sf))
    return d.join(u.select("point_id", "change_id", "line", "n_changed"), "point_id").select("change_id", "line", "n_changed", "declaration")


@query("c31_contexts", V.sql_with("v_parsed v_symbols v_code", POINTS + """,
tab AS (SELECT file, side, string_agg(name, ',' ORDER BY start) AS names FROM (SELECT *, row_number() OVER (PARTITION BY file, side ORDER BY start) AS r FROM v_symbols WHERE depth = 0) WHERE r <= 40 GROUP BY file, side)
SELECT change_id, line, n_changed, names AS symbols, symbol AS enclosing, CASE WHEN names IS NOT NULL THEN coalesce((SELECT string_agg(rtrim(text, ' '), chr(10) ORDER BY i) FROM v_code c WHERE c.file = p.file AND c.i + 1 BETWEEN nstart AND least(nend, nstart + 19)), '') END AS context
FROM pts p LEFT JOIN enc USING (change_id, h, lo) LEFT JOIN tab t ON t.file = p.file AND t.side = p.side"""))
def c31(spark, sf):
    u, gone = _units(spark, sf)
    c = U.contexts(u, gone, symbols(spark, sf), _file_lines(spark, sf))
    return c.join(u.select("point_id", "change_id", "line", "n_changed"), "point_id").select(
        "change_id", "line", "n_changed", F.array_join("ast_context.symbols", ",").alias("symbols"), F.col("ast_context.enclosing").alias("enclosing"), F.array_join("ast_context.context", "\n").alias("context"))


@query("c21_state_context", V.sql_with("v_parsed v_symbols v_code", POINTS + """,
tab AS (SELECT file, side, string_agg(name, ',' ORDER BY start) AS names FROM (SELECT *, row_number() OVER (PARTITION BY file, side ORDER BY start) AS r FROM v_symbols WHERE depth = 0) WHERE r <= 40 GROUP BY file, side)
SELECT change_id, line, change_type, n_changed, names IS NOT NULL AS has_context, names AS symbols, CASE WHEN names IS NOT NULL THEN symbol END AS enclosing, CASE WHEN names IS NOT NULL THEN coalesce((SELECT string_agg(rtrim(text, ' '), chr(10) ORDER BY i) FROM v_code c WHERE c.file = p.file AND c.i + 1 BETWEEN nstart AND least(nend, nstart + 19)), '') END AS context
FROM pts p LEFT JOIN enc USING (change_id, h, lo) LEFT JOIN tab t ON t.file = p.file AND t.side = p.side"""))
def c21_context(spark, sf):
    # lines and units are read several times, so each is written once
    m = written(members(spark, sf), "members").repartition("change_id")
    pid = F.concat_ws(":", F.col("change_id").cast("string"), F.col("hunk_no").cast("string"), F.col("run").cast("string"))
    u = written(P.clusters(m, with_entries=True).withColumn("point_id", pid), "units")
    gone = m.filter("own and kind = '-'").groupBy(pid.alias("point_id")).agg(F.min_by("old_line", "pos").alias("first_old_line"))
    states = P.unit_states(u.join(U.contexts(u, gone, symbols(spark, sf), _file_lines(spark, sf)), "point_id", "left"))
    found = F.from_json(F.get_json_object("state", "$.ast_context"), "symbols array<string>, enclosing string, context array<string>")
    return states.withColumn("c", found).select("change_id", "line", "change_type", "n_changed", F.col("state").contains('"ast_context":').alias("has_context"),
                                                F.array_join("c.symbols", ",").alias("symbols"), F.col("c.enclosing").alias("enclosing"), F.array_join("c.context", "\n").alias("context"))


@query("c29_context_census", V.sql_with("v_code v_symbols", """
WITH g AS (SELECT doc_id, i, file, CAST(i + 1 AS INTEGER) AS "at" FROM v_code),
e AS (SELECT g.doc_id, g.i, string_agg(name, '.' ORDER BY depth, start) AS symbol, arg_min(start, ("end" - start) * 1000000 - start) AS ns, arg_min("end", ("end" - start) * 1000000 - start) AS ne FROM g JOIN v_symbols s ON s.file = g.file AND side = 'after' AND "at" BETWEEN start AND "end" GROUP BY ALL),
t AS (SELECT DISTINCT file FROM v_symbols), n AS (SELECT file, max(i) + 1 AS n FROM v_code GROUP BY file),
x AS (SELECT g.*, e.symbol, ns, t.file IS NOT NULL AS has, CASE WHEN ns IS NULL THEN 0 ELSE least(ne, ns + 19, n) - ns + 1 END AS w FROM g LEFT JOIN e USING (doc_id, i) LEFT JOIN t USING (file) JOIN n USING (file)),
tab AS (SELECT file, list(name ORDER BY start) AS names FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY start) AS r FROM v_symbols WHERE depth = 0 AND side = 'after') WHERE r <= 40 GROUP BY file),
txt AS (SELECT x.doc_id, x.i, list(rtrim(c.text, ' ') ORDER BY c.i) AS lines FROM x JOIN v_code c ON c.file = x.file AND c.i + 1 BETWEEN ns AND ns + w - 1 GROUP BY x.doc_id, x.i),
chars AS (SELECT sum(length(CASE WHEN x.symbol IS NULL THEN to_json({'symbols': names, 'context': []::VARCHAR[]}) ELSE to_json({'symbols': names, 'enclosing': x.symbol, 'context': lines}) END)) AS n
  FROM x JOIN tab USING (file) LEFT JOIN txt USING (doc_id, i) WHERE doc_id % 11 <> 2)
SELECT count(*) AS rows, (SELECT round(n / 3e0, 6) FROM chars) AS added_tokens, count(*) FILTER (WHERE doc_id % 11 = 2) AS missing, count(*) FILTER (WHERE has AND doc_id % 11 <> 2) AS enriched, count(*) FILTER (WHERE has AND doc_id % 11 <> 2 AND ns IS NOT NULL AND "at" < ns + w) AS covered,
  CAST(median(w) FILTER (WHERE has AND doc_id % 11 <> 2) AS DOUBLE) AS median_window FROM x"""))
def c29(spark, sf):
    c = code_lines(spark, sf)
    golden = c.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("i").cast("string")).alias("point_id"), "file", (F.col("i") + 1).alias("line"))
    return U.context_census(golden, c.filter("doc_id % 11 <> 2"), symbols(spark, sf), _file_lines(spark, sf)).withColumn("added_tokens", F.round("added_tokens", 6))
