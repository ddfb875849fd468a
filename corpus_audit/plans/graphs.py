"""Import and link graph queries.

Modules are the derived source files; their import lines name each other, so the graph has real
cycles, dead ends and targets that do not exist.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, rules
from . import inputs as i
from .catalog import query

ALIASES = [("@/", "src/"), ("@ui/", "ui/")]

# Statement of the graph for SQL: literal statement shapes of the derived corpus.
EDGES_SQL = i.CODE_LINES_SQL + r""",
stm AS (SELECT path AS src, raw, CASE WHEN regexp_matches(raw, '^import [^'']*''') THEN 'import'
WHEN regexp_matches(raw, '^export \{') THEN 'reexport' WHEN regexp_matches(raw, 'require\(''') THEN 'require'
WHEN regexp_matches(raw, 'import\(''') THEN 'dynamic' END AS kind FROM cl),
edges AS (SELECT src, regexp_extract(raw, '(?:from |require\(|import\()''([^'']*)''', 1) AS spec, kind FROM stm WHERE kind IS NOT NULL),
stems AS (SELECT src, spec, kind, CASE WHEN spec LIKE '../%' THEN 'src/' || substr(spec, 4) WHEN spec LIKE '@/%' THEN 'src/' || substr(spec, 3)
WHEN spec LIKE '@ui/%' THEN 'ui/' || substr(spec, 5) END AS stem FROM edges),
status AS (SELECT s.src, s.spec, s.kind, c.path AS dst, CASE WHEN stem IS NULL THEN 'external' WHEN c.path IS NULL THEN 'no such file' END AS reason
FROM stems s LEFT JOIN code c ON regexp_replace(c.path, '\.[a-z]+$', '') = s.stem),
resolved AS (SELECT src, spec, kind, dst FROM status WHERE dst IS NOT NULL),
e AS (SELECT DISTINCT src, dst FROM resolved),
zn AS (SELECT path, zone, role, prefix FROM (SELECT c.path, z.zone, z.role, z.prefix,
row_number() OVER (PARTITION BY c.path ORDER BY length(z.prefix) DESC) AS rn FROM code c JOIN zones z ON starts_with(c.path, z.prefix || '/')) WHERE rn = 1)"""
GRAPH = (i.ZONES_SQL, i.ALLOWED_SQL, EDGES_SQL)


def module_edges(t):
    files = i.code_files(t).select("path", "text")
    return graph.resolve_edges(graph.extract_edges(files), files, ALIASES)


def zoned(t):
    return graph.assign_zone(i.code_files(t), i.zone_registry(t))


@query("grf01_extract_edges", i.ctes(*GRAPH) + "SELECT src, spec, kind FROM edges")
def extract_edges(t):
    return graph.extract_edges(i.code_files(t))


@query("grf01_page_links", """
SELECT url AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS spec, 'href' AS kind FROM pages""")
def page_links(t):
    return graph.extract_edges(t.pages.select(F.col("url").alias("path"), F.col("html").alias("text")), ("href",))


@query("grf02_resolve_edges", i.ctes(*GRAPH) + "SELECT src, spec, kind, coalesce(dst, '-') AS dst, coalesce(reason, 'resolved') AS reason FROM status")
def resolve_edges(t):
    _, status = module_edges(t)
    return status.select("src", "spec", "kind", F.coalesce("dst", F.lit("-")).alias("dst"),
                         F.coalesce("reason", F.lit("resolved")).alias("reason"))


@query("grf02_coverage", i.ctes(*GRAPH) + """
SELECT count(*) FILTER (reason IS NULL OR reason <> 'external') AS internal, count(dst) AS resolved,
count(*) FILTER (reason = 'no such file') AS unresolved, count(*) FILTER (reason = 'external') AS external,
round(count(dst) / count(*) FILTER (reason IS NULL OR reason <> 'external'), 6) AS coverage FROM status""")
def coverage(t):
    return graph.coverage(module_edges(t)[1])


@query("grf02_page_link_coverage", r"""
WITH l AS (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS spec FROM pages),
p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '[?#].*$', '') AS path FROM pages)
SELECT count(*) AS internal, count(path) AS resolved, count(*) - count(path) AS unresolved, 0 AS external,
round(count(path) / count(*), 6) AS coverage FROM (SELECT spec, path FROM l LEFT JOIN p ON substr(spec, 2) = path)""")
def page_link_coverage(t):
    pages = t.pages.select(F.col("url").alias("path"), F.col("html").alias("text"))
    paths = t.pages.select(F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*/", ""), "[?#].*$", "").alias("path"))
    return graph.coverage(graph.resolve_edges(graph.extract_edges(pages, ("href",)), paths)[1])


# Every file that re-exports a name acts as a barrel for that name.
_BARRELS = r""",
sy AS (SELECT src, dst, kind, regexp_extract(raw, '\{ ([A-Za-z0-9_]+) \}', 1) AS symbol FROM (
SELECT s.path AS src, s.raw, CASE WHEN s.raw LIKE 'export%' THEN 'reexport' ELSE 'import' END AS kind, c.path AS dst FROM cl s JOIN code c
ON regexp_replace(c.path, '\.[a-z]+$', '') = 'src/' || regexp_extract(s.raw, '(src[0-9]+/doc_[0-9]+)''', 1)
WHERE regexp_matches(s.raw, '^(import|export) \{ [A-Za-z0-9]+ \} from'))),
rx AS (SELECT src AS barrel, 'any' AS symbol, min(dst) AS target FROM sy WHERE kind = 'reexport' AND src <> dst GROUP BY 1),
hop AS (SELECT barrel, target, 1 AS d FROM rx UNION SELECT h.barrel, r.target, d + 1 FROM hop h JOIN rx r ON h.target = r.barrel WHERE d < 64),
looped AS (SELECT DISTINCT barrel FROM hop WHERE d = 64),
final AS (SELECT barrel, arg_max(target, d) AS target FROM hop WHERE barrel NOT IN (SELECT barrel FROM looped) GROUP BY 1)"""


@query("grf03_flatten_barrels", i.ctes(EDGES_SQL, _BARRELS.lstrip(",\n")) + """
SELECT src, coalesce(target, dst) AS dst, count(*) AS edges FROM sy LEFT JOIN final ON dst = barrel GROUP BY 1, 2""")
def flatten_barrels(t):
    files = i.code_files(t).select("path", "text")
    edges, _ = graph.resolve_edges(graph.extract_symbol_edges(files), files, ALIASES)
    # The corpus re-exports each name under its own number; one shared name makes the chains meet.
    edges = edges.withColumn("symbol", F.lit("any"))
    barrels = edges.filter("kind = 'reexport'").select(F.col("src").alias("barrel"), "symbol", F.col("dst").alias("target"))
    return graph.flatten_barrels(edges, barrels).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("edges"))


@query("grf04_fan_in_out", i.ctes(*GRAPH) + """
SELECT module, sum(fi)::BIGINT AS fan_in, sum(fo)::BIGINT AS fan_out FROM (SELECT dst AS module, 1 AS fi, 0 AS fo FROM e UNION ALL SELECT src, 0, 1 FROM e) GROUP BY 1""")
def fan_in_out(t):
    return graph.fan_in_out(module_edges(t)[0])


_ZE = """, ze AS (SELECT e.src, e.dst, a.zone AS src_zone, b.zone AS dst_zone FROM e JOIN zn a ON a.path = src JOIN zn b ON b.path = dst)"""


@query("grf05_boundary_breaches", i.ctes(*GRAPH, _ZE.lstrip(", ")) +
       "SELECT * FROM ze WHERE (src_zone, dst_zone) NOT IN (SELECT src_zone, dst_zone FROM allowed)")
def boundary_breaches(t):
    return graph.boundary_breaches(module_edges(t)[0], zoned(t), i.allowed_pairs(t))


@query("grf05_unzoned_edges", i.ctes(*GRAPH) + """
SELECT src, dst, CASE WHEN s.zone IS NULL AND d.zone IS NULL THEN 'no zone' WHEN s.zone IS NULL THEN 'source without zone' ELSE 'target without zone' END AS reason
FROM e LEFT JOIN zn s ON s.path = src LEFT JOIN zn d ON d.path = dst WHERE s.zone IS NULL OR d.zone IS NULL""")
def unzoned_edges(t):
    return graph.unzoned_edges(module_edges(t)[0], zoned(t))


_REACH = "reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst)"


@query("grf06_cycles", i.ctes(*GRAPH, _REACH) + """
SELECT a.src AS module, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src
WHERE a.src IN (SELECT src FROM reach WHERE src = dst) GROUP BY 1""")
def cycles(t):
    return graph.cycles(module_edges(t)[0])


_BLAST = """hit AS (SELECT path AS module, 0 AS distance FROM code WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION SELECT e.src, distance + 1 FROM hit JOIN e ON e.dst = module WHERE distance < 3)"""


@query("grf07_blast_radius", i.ctes(*GRAPH, _BLAST) + "SELECT module, min(distance) AS distance FROM hit GROUP BY 1")
def blast_radius(t):
    bad = t.labels.filter("toxic = 1").select("doc_id").distinct()
    changed = i.code_files(t).join(bad, "doc_id", "left_semi").select(F.col("path").alias("module"))
    return graph.blast_radius(module_edges(t)[0], changed, 3)


@query("grf08_zone_adjacency", i.ctes(*GRAPH, _ZE.lstrip(", ")) + "SELECT src_zone, dst_zone, count(*) AS edges FROM ze GROUP BY 1, 2")
def zone_adjacency(t):
    return graph.zone_adjacency(module_edges(t)[0], zoned(t))


@query("grf09_misplaced", i.ctes(*GRAPH) + """
SELECT path, lang AS kind, zone, expected_zone FROM (SELECT code.path, lang, zn.zone FROM code JOIN zn USING (path)) JOIN
(SELECT CASE r_regionkey WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END AS lang, min(r_name) AS expected_zone FROM region GROUP BY 1)
USING (lang) WHERE zone <> expected_zone""")
def misplaced(t):
    kind = (F.when(F.col("r_regionkey") == 0, "en").when(F.col("r_regionkey") == 1, "fr")
            .when(F.col("r_regionkey") == 2, "de").otherwise("es"))
    layout = t.region.groupBy(kind.alias("kind")).agg(F.min("r_name").alias("zone"))
    files = i.code_files(t).select("path", F.col("lang").alias("kind")).join(zoned(t).select("path", "zone"), "path")
    return graph.misplaced(files, layout)


@query("grf10_assign_zone", i.ctes(*GRAPH) + "SELECT path, prefix, zone, role FROM zn")
def assign_zone(t):
    return zoned(t)


@query("grf11_graph_digest", i.ctes(*GRAPH) + """
SELECT count(*) AS edges, sum(('0x' || substr(md5(src || '|' || dst || '|' || kind), 1, 15))::BIGINT)::VARCHAR AS digest
FROM (SELECT DISTINCT src, dst, kind FROM resolved)""")
def graph_digest(t):
    return graph.graph_digest(module_edges(t)[0])


@query("grf11_ordered_edges", i.ctes(*GRAPH) + "SELECT DISTINCT src, dst, kind FROM resolved ORDER BY 1, 2, 3")
def ordered_edges(t):
    return graph.ordered_edges(module_edges(t)[0])


@query("rul12_undeclared_imports", i.ctes(*GRAPH, r"""pk AS (
SELECT DISTINCT src, regexp_extract(spec, '^(@[^/]+/[^/]+|[^/]+)', 1) AS package FROM edges WHERE NOT regexp_matches(spec, '^[./]')
AND spec NOT LIKE '@/%' AND spec NOT LIKE '%:%')""") + """
SELECT src, package FROM pk WHERE package NOT IN (SELECT package FROM pk WHERE package LIKE '@%')""")
def undeclared_imports(t):
    packages = graph.package_imports(graph.extract_edges(i.code_files(t)), [("@/", "src/")])
    # The manifest names the in-house packages only.
    declared = packages.filter(F.col("package").startswith("@")).select("package")
    return rules.undeclared_imports(packages, declared).select("src", "package")
