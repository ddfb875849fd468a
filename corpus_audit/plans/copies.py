"""Duplicate, dead-code, complexity and test queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clones, components, duplicates, graph, similarity, sketches
from ..session import cut_lineage
from . import inputs as i
from .catalog import query
from .inputs import sql_text


@query("dup01_exact_duplicates", """
SELECT sha256(text) AS hash, min('docs/' || source || '/' || doc_id) AS canonical, count(*) AS copies
FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_duplicates(t):
    return duplicates.exact_duplicates(i.prose_files(t))


@query("dup01_redundant_files", i.ctes(i.PROSE_SQL) + """
SELECT path, canonical FROM (SELECT path, min(path) OVER (PARTITION BY text) AS canonical FROM prose) WHERE path <> canonical""")
def redundant_files(t):
    return duplicates.redundant_files(i.prose_files(t))


_WINDOWS = r"""nl AS (SELECT path, line_no, row_number() OVER (PARTITION BY path ORDER BY line_no) AS idx, line FROM (
SELECT path, line_no, trim(regexp_replace(line, '[ \t\r]+', ' ', 'g')) AS line FROM pl) WHERE line <> ''),
win AS (SELECT path, idx, line_no AS line_start, lead(line_no, 2) OVER w AS line_end,
line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS block FROM nl WINDOW w AS (PARTITION BY path ORDER BY idx)),
full_win AS (SELECT *, md5(block) AS hash FROM win WHERE block IS NOT NULL),
rep AS (SELECT hash, count(*) AS occurrences, count(DISTINCT path) AS files FROM full_win GROUP BY 1 HAVING count(*) > 1)"""


@query("dup02_repeated_blocks", i.ctes(i.PROSE_LINES_SQL, _WINDOWS) + "SELECT * FROM rep")
def repeated_blocks(t):
    return duplicates.repeated_blocks(i.prose_files(t), 3)


@query("dup02_block_duplicates", i.ctes(i.PROSE_LINES_SQL, _WINDOWS) + """
SELECT path, min(line_start) AS line_start, max(line_end) AS line_end FROM (SELECT *, idx - row_number() OVER (PARTITION BY path ORDER BY idx) AS island
FROM full_win WHERE hash IN (SELECT hash FROM rep)) GROUP BY path, island""")
def block_duplicates(t):
    return duplicates.block_duplicates(i.prose_files(t), 3)


# Repeated runs grow window by window until each is alone; m windows are m + 2 lines.
_RUNS = r"""marks AS MATERIALIZED (SELECT path, idx, line_start, line_end, hash FROM full_win WHERE hash IN (SELECT hash FROM rep)),
runs AS (SELECT path, idx, 1 AS m, hash AS code FROM marks
UNION ALL SELECT path, idx, m, code FROM (SELECT r.path, r.idx, r.m + 1 AS m, md5(r.code || w.hash) AS code
FROM runs r JOIN marks w ON w.path = r.path AND w.idx = r.idx + r.m) QUALIFY count(*) OVER (PARTITION BY code) > 1),
known AS MATERIALIZED (SELECT * FROM runs),
tops AS (SELECT path, idx, max(m) AS m, max_by(code, m) AS code FROM known GROUP BY 1, 2),
starts AS (SELECT * FROM tops t WHERE NOT EXISTS (SELECT 1 FROM tops b WHERE b.path = t.path AND b.idx = t.idx - 1 AND b.m = t.m + 1)),
classes AS (SELECT m, code, count(*) AS copies, min(ROW(path, idx)) AS first FROM known GROUP BY 1, 2)
SELECT s.path, a.line_start, z.line_end, (s.m + 2)::BIGINT AS lines, c.copies, o.path AS origin_path, o.line_start AS origin_line
FROM starts s JOIN classes c USING (m, code) JOIN marks a ON a.path = s.path AND a.idx = s.idx
JOIN marks z ON z.path = s.path AND z.idx = s.idx + s.m - 1 JOIN marks o ON ROW(o.path, o.idx) = c.first"""


@query("dup02_clone_classes", i.ctes(i.PROSE_LINES_SQL, _WINDOWS) .rstrip() + ",\n" + _RUNS)
def clone_classes(t):
    return clones.clone_classes(i.prose_files(t), 3)


@query("dup03_repeated_lines", i.ctes(i.PROSE_LINES_SQL) + """
SELECT line, count(*) AS occurrences, count(DISTINCT path) AS files FROM pl GROUP BY 1 HAVING count(*) >= 3""")
def repeated_lines(t):
    return duplicates.repeated_lines(i.prose_files(t), 3)


# All pairs that share a shingle are counted, and closed over.
_NEAR = r"""
ws AS (SELECT path, list_filter(regexp_split_to_array(lower(text), '[^\p{L}0-9]+'), lambda x: x <> '') AS w FROM prose),
lead0 AS (SELECT path, w, min(path) OVER (PARTITION BY array_to_string(w, ' ')) AS first FROM ws WHERE len(w) > 0),
sets AS MATERIALIZED (SELECT path, list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i+2], ' '))) AS grams
FROM lead0 WHERE path = first),
grams AS MATERIALIZED (SELECT path, unnest(grams) AS gram FROM sets),
met AS (SELECT a.path AS a, b.path AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.path < b.path GROUP BY 1, 2),
hit AS MATERIALIZED (SELECT a, b FROM met JOIN sets x ON x.path = a JOIN sets y ON y.path = b WHERE round(n / (len(x.grams) + len(y.grams) - n), 6) >= 0.7),
tied AS (SELECT a, b FROM hit UNION SELECT b, a FROM hit),
joined AS (SELECT a AS path, a AS m FROM tied UNION SELECT t.b, j.m FROM joined j JOIN tied t ON t.a = j.path),
grouped AS (SELECT path, min(m) AS leader FROM joined GROUP BY 1),
scored AS (SELECT g.path, g.leader, len(list_intersect(x.grams, y.grams)) AS n, len(x.grams) AS nx, len(y.grams) AS ny
FROM grouped g JOIN sets x ON x.path = g.path JOIN sets y ON y.path = g.leader WHERE g.path <> g.leader),
links AS (SELECT l.path, coalesce(leader, first) AS leader, coalesce(round(n / (nx + ny - n), 6), 1.0) AS score
FROM lead0 l LEFT JOIN scored s ON s.path = l.first WHERE l.path <> coalesce(leader, first))"""


@query("dup04_near_duplicates", i.ctes(i.PROSE_SQL, _NEAR) + "SELECT path, leader, score FROM links")
def near_duplicates(t):
    return similarity.near_duplicates(i.prose_files(t), 0.7)


# Every tenth vector comes again with two of its places exchanged and one cut down.  The SQL compares all pairs.
_SEMANTIC = """
v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings UNION ALL
SELECT vec_id + 100000000, list_transform(embedding::DOUBLE[], lambda x, j: CASE j WHEN 1 THEN embedding[2]::DOUBLE WHEN 2 THEN embedding[1]::DOUBLE
WHEN 3 THEN x / 2 ELSE x END) FROM embeddings WHERE vec_id % 10 = 0),
hit AS MATERIALIZED (SELECT a.vec_id, b.vec_id AS leader, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id > b.vec_id
WHERE round(list_cosine_similarity(a.e, b.e), 6) >= 0.8)"""


@query("dup05_semantic_duplicates", i.ctes(_SEMANTIC) + """
SELECT vec_id, leader, score FROM hit WHERE leader NOT IN (SELECT vec_id FROM hit)""")
def semantic_duplicates(t):
    e = F.col("embedding").cast("array<double>")
    changed = F.transform(e, lambda x, j: F.when(j == 0, e[1]).when(j == 1, e[0]).when(j == 2, x / 2).otherwise(x))
    again = t.embeddings.filter("vec_id % 10 = 0").select((F.col("vec_id") + 100000000).alias("vec_id"), changed.alias("embedding"))
    return similarity.semantic_duplicates(t.embeddings.select("vec_id", e.alias("embedding")).unionByName(again), 0.8)


_IMPORTS = i.CODE_SQL + r""", ed AS (SELECT path AS src, regexp_extract(x, '''([^'']*)''', 1) AS spec FROM (
SELECT path, unnest(regexp_extract_all(text, '(import|export) \{[^}\n]*\} from ''[^'']*''')) AS x FROM code)),
pairs AS (SELECT DISTINCT src AS a, c.path AS b FROM (SELECT src, replace(replace(spec, '../', 'src/'), '@/', 'src/') AS stem FROM ed) e
JOIN code c ON regexp_replace(c.path, '\.[a-z]+$', '') = e.stem)"""
_LABELS = """sym AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS node, a AS m FROM sym UNION SELECT s.b, r.m FROM reach r JOIN sym s ON s.a = r.node)"""


def _import_pairs(t):
    files = i.code_files(t)
    edges = graph.extract_edges(files).filter("kind in ('import', 'reexport')").filter("spec like '%src%'")
    resolved, _ = graph.resolve_edges(edges, files, [("@/", "src/")])
    return resolved.select(F.col("src").alias("a"), F.col("dst").alias("b"))


@query("dup06_clusters", i.ctes(_IMPORTS, _LABELS) + "SELECT node, min(m) AS component FROM reach GROUP BY 1")
def clusters(t):
    return components.components(_import_pairs(t))


@query("dup06_near_duplicate_clusters", i.ctes(i.PROSE_SQL, _NEAR, """
sym AS (SELECT path AS a, leader AS b FROM links UNION SELECT leader, path FROM links),
reach AS (SELECT a AS node, a AS m FROM sym UNION SELECT s.b, r.m FROM reach r JOIN sym s ON s.a = r.node)""") +
       "SELECT node, min(m) AS component FROM reach GROUP BY 1")
def near_duplicate_clusters(t):
    return components.components(similarity.near_duplicates(i.prose_files(t), 0.7), "path", "leader")


_BOUND = r"""imp AS (SELECT path, line_no, line FROM sl WHERE regexp_matches(line, '""" + duplicates.IMPORT_LINE + r"""')),
bound AS (SELECT path, line_no, trim(unnest(string_split(regexp_extract(line, '""" + duplicates.BRACED + r"""', 1), ','))) AS symbol FROM imp
UNION ALL SELECT path, line_no, regexp_extract(line, '""" + duplicates.DEFAULT_NAME + r"""', 1) FROM imp),
toks AS (SELECT DISTINCT path, unnest(regexp_split_to_array(line, '[^A-Za-z0-9_$]+')) AS tok FROM sl
WHERE NOT regexp_matches(line, '""" + duplicates.IMPORT_LINE + r"""'))"""


@query("dup07_unused_imports", i.ctes(i.CODE_LINES_SQL, _BOUND) + r"""
SELECT path, line_no AS line_start, symbol FROM bound WHERE symbol <> '' AND (path, symbol) NOT IN (SELECT path, tok FROM toks)
AND NOT (symbol = 'React' AND regexp_matches(path, '\.(tsx|jsx)$'))""")
def unused_imports(t):
    return duplicates.unused_imports(i.code_files(t)).select("path", "line_start", "symbol")


@query("dup08_unused_exports", i.ctes(i.CODE_SQL) + r"""
, ex AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, 'export (?:const|function) ([A-Za-z0-9_]+)', 1)) AS symbol FROM code),
im AS (SELECT DISTINCT 'src/' || regexp_extract(x, '(src[0-9]+/doc_[0-9]+)', 1) AS stem, regexp_extract(x, '\{ ([A-Za-z0-9_]+) \}', 1) AS symbol
FROM (SELECT unnest(regexp_extract_all(text, '(?:import|export) \{[^}\n]*\} from ''[^''\n]*src[^''\n]*''')) AS x FROM code))
SELECT path, symbol FROM ex WHERE (regexp_replace(path, '\.[a-z]+$', ''), symbol) NOT IN (SELECT stem, symbol FROM im)""")
def unused_exports(t):
    files = i.code_files(t)
    edges = graph.extract_symbol_edges(files)
    resolved, _ = graph.resolve_edges(edges, files, [("@/", "src/")])
    return duplicates.unused_exports(duplicates.exports(files), resolved)


_CX = f"cx AS (SELECT path, zone, len(string_split(text, chr(10))) AS lines, len(regexp_extract_all(text, {sql_text(duplicates.BRANCH)})) + 1 AS complexity FROM code)"


@query("dup09_complexity", i.ctes(i.CODE_SQL, _CX) + "SELECT * FROM cx")
def complexity(t):
    return duplicates.complexity(i.code_files(t))


@query("dup09_hotspots", i.ctes(i.CODE_SQL, _CX) + """
SELECT path, zone, complexity, round(zone_bar, 6) AS zone_bar FROM cx LEFT JOIN (SELECT zone, quantile_cont(complexity, 0.9) AS zone_bar FROM cx GROUP BY 1) USING (zone)
WHERE complexity > 12 OR complexity > zone_bar""")
def hotspots(t):
    return duplicates.complexity_hotspots(i.code_files(t), 12).select(
        "path", "zone", "complexity", F.round("zone_bar", 6).alias("zone_bar"))


@query("dup09_complexity_sketches", i.ctes(i.CODE_SQL, _CX) + "SELECT zone, count(*) AS n, true AS within FROM cx GROUP BY 1")
def complexity_sketches(t):
    """The 0.9 quantile of each zone from the sketches of four runs, whose exact rank is at most 1 % off."""
    measured = cut_lineage(duplicates.complexity(i.code_files(t)))
    runs = sketches.measure_sketches(measured, "complexity", F.concat(F.lit("run-"), F.pmod(F.xxhash64("path"), F.lit(4))))
    bars = sketches.quantiles(runs, 0.9)
    share = [F.avg((F.col("complexity") < F.col("bar")).cast("double")), F.avg((F.col("complexity") <= F.col("bar")).cast("double"))]
    off = 0.01 + 1 / F.first("n")
    return measured.join(bars, "zone").groupBy("zone").agg(
        F.first("n").alias("n"), ((share[0] <= 0.9 + off) & (share[1] >= 0.9 - off)).alias("within"))


@query("dup10_untested_modules", i.ctes(i.CODE_SQL) + f"""
SELECT path FROM code WHERE regexp_matches(text, {sql_text(duplicates.LOGIC)})
AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def untested_modules(t):
    return duplicates.untested_modules(i.code_files(t), i.test_files(t))


@query("dup11_assertion_quality", i.ctes(i.TESTS_SQL) + f"""
SELECT *, density < 1.0 AS weak FROM (SELECT path, cases, assertions, trivial, round((assertions - trivial) / greatest(cases, 1), 6) AS density FROM (
SELECT path, len(regexp_extract_all(text, {sql_text(duplicates.CASE)})) AS cases, len(regexp_extract_all(text, {sql_text(duplicates.ASSERTION)})) AS assertions,
len(regexp_extract_all(text, {sql_text(duplicates.TRIVIAL)})) AS trivial FROM tests))""")
def assertion_quality(t):
    return duplicates.assertion_quality(i.test_files(t))


_PRIORITY = """churn AS (SELECT entity AS stem, count(*) AS changes FROM history GROUP BY 1),
cov AS (SELECT doc_id, count(*) AS covered FROM labels WHERE quality = 1 GROUP BY 1),
j AS (SELECT path, complexity, coalesce(changes, 0) AS changes, coalesce(covered, 0) AS covered FROM cx JOIN code USING (path)
LEFT JOIN churn ON stem = regexp_replace(path, '\\.[a-z]+$', '') LEFT JOIN cov USING (doc_id)),
r AS (SELECT *, percent_rank() OVER (ORDER BY complexity) AS r1, percent_rank() OVER (ORDER BY changes) AS r2,
percent_rank() OVER (ORDER BY covered) AS r3 FROM j)"""


@query("dup12_priority_sample", i.ctes(i.CODE_SQL, _CX, i.HISTORY_SQL, _PRIORITY) + """
SELECT path, complexity, changes, covered, round((r1 + r2 + (1 - r3)) / 3, 6) AS priority FROM r ORDER BY priority DESC, path LIMIT 50""")
def priority_sample(t):
    files = i.code_files(t)
    stem = F.regexp_replace("path", r"\.[a-z]+$", "").alias("entity")
    churn = (files.select("path", stem).join(i.history(t).groupBy("entity").agg(F.count(F.lit(1)).alias("changes")), "entity"))
    good = t.labels.filter("quality = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("covered"))
    coverage = files.select("path", "doc_id").join(good, "doc_id")
    return duplicates.priority_sample(files, churn, coverage, 50)
