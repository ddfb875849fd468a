"""Corpora, graphs and histories that Spark derives from the given tables.

The given documents are prose.  The audit jobs want source files, so every line of every document is
rendered as one line of code picked by the line's length: the corpus grows with ``documents`` and any
SQL engine can state the same text.  ``*_SQL`` holds those statements as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .catalog import Tables

# One line of code per line of prose; {n} is the length of the prose line, {s} its folder.
CODE_LINES = (
    "import React from 'react';",
    "import { helper } from '../src{s}/doc_{n}';",
    "import axios from 'axios';",
    "import { shared{n} } from '@/src{s}/doc_{n}';",
    "export { value{n} } from '../src{s}/doc_{n}';",
    "const mod{n} = require('../src{s}/doc_{n}');",
    "const page{n} = await import('../src{s}/doc_{n}');",
    "tide_secret = 'harbour-{n}-plum'",
    "chart = 'http://tiles.harbour.test/v2/sheet?key=' + slot{n}",
    "  hasher = hashlib.md5(block{n})",
    "  berths = ledger.query(",
    "    'SELECT berth, depth FROM quays WHERE depth > ' + draft{n}",
    "  eval(input{n});",
    "  console.info('pilot cleared by token', pass{n});",
    "  console.log('loaded', {n});",
    "  res.status(500).send(err.stack);",
    "const config = { debug: true, id: {n} };",
    "server.post('/quays/{n}/arrivals', admitVessel);",
    "  skipper = ctx.query.skipper",
    "  manifest = request.body",
    "export function pick{n}(item: any): string {",
    "  return value as any;",
    "  <aside style={{ minWidth: '940px' }}>",
    "  <button className=\"hoist\" onClick={raise}>",
    "  {cranes.map((crane, slot) =>",
    "    <td className=\"bay\" onClick={inspect}>",
    "  const raw = fs.readFileSync(path{n});",
    "  await Promise.all(rows{n}.map(load));",
    "  for (const row of rows) {",
    "  const one = await db.findOne({ id: {n} });",
    "  localStorage.setItem('token', token{n});",
    "  // const old{n} = compute(old);",
    "  // if (legacy{n}) { return; }",
    "  // return legacy{n};",
    "  const timer = setInterval(tick, {n});",
    "  clearInterval(timer);",
    "  if (user.role === 'admin' && allowed) {",
    "  } else if (count > {n}) {",
    "  while (queue.length > 0) {",
    "  requireAuth(req);",
    "  return compute({n});",
    "}",
    "export const value{n} = {n};",
    "import { Button } from '@ui/kit';",
    "  <button aria-label=\"Raise\" onClick={raise}>",
    "  <td key={slot}>{crane}</td>",
    "  switch (kind) { case 'a': return one; }",
    "",
)
TEST_LINES = (
    "it('case {n}', () => {",
    "  expect(compute({n})).toBe({n});",
    "  expect(true).toBe(true);",
    "  const got = compute({n});",
    "});",
)
EXTENSIONS = {"en": ".tsx", "fr": ".ts", "de": ".js", "es": ".py"}
ADDED_LINE = "export const extra = 1;"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _rendered(text, templates):
    options = F.array(*[F.lit(t) for t in templates])
    def line(x):
        n = F.length(x)
        chosen = F.element_at(options, n % len(templates) + 1)
        return F.replace(F.replace(chosen, F.lit("{n}"), n.cast("string")), F.lit("{s}"),
                         (n % 20).cast("string"))
    return F.array_join(F.transform(tx.lines_of(text), line), "\n")


def _rendered_sql(text: str, templates) -> str:
    options = "[" + ", ".join(sql_text(t) for t in templates) + "]"
    return (f"array_to_string(list_transform(string_split({text}, chr(10)), lambda x: replace(replace("
            f"list_extract({options}, (length(x) % {len(templates)})::INT + 1), '{{n}}', length(x)::VARCHAR), "
            f"'{{s}}', (length(x) % 20)::VARCHAR)), chr(10))")


def _extension(lang):
    column = F.lit("")
    for name, ext in EXTENSIONS.items():
        column = F.when(lang == name, F.lit(ext)).otherwise(column)
    return column


_EXT_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXTENSIONS.items()) + " ELSE '' END"


def prose_files(t: Tables) -> DataFrame:
    """The documents as files of a corpus."""
    return t.documents.select(
        F.concat(F.lit("docs/"), "source", F.lit("/"), "doc_id").alias("path"), "text", "lang",
        F.col("source").alias("zone"), "doc_id")


PROSE_SQL = "prose AS (SELECT 'docs/' || source || '/' || doc_id AS path, text, lang, source AS zone, doc_id FROM documents)"
PROSE_LINES_SQL = (PROSE_SQL + ", pl AS (SELECT path, lang, zone, doc_id, unnest(l) AS line, "
                   "unnest(range(1, len(l) + 1)) AS line_no FROM "
                   "(SELECT *, string_split(text, chr(10)) AS l FROM prose))")


def code_files(t: Tables) -> DataFrame:
    """One source file per document."""
    return t.documents.select(
        F.concat(F.lit("src/"), "source", F.lit("/doc_"), "doc_id", _extension(F.col("lang"))).alias("path"),
        _rendered(F.col("text"), CODE_LINES).alias("text"), "lang",
        F.col("source").alias("zone"), F.col("source").alias("author"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_chars") % 30).cast("int")).alias("mtime"),
        "doc_id")


CODE_SQL = (f"code AS (SELECT 'src/' || source || '/doc_' || doc_id || {_EXT_SQL} AS path, "
            f"{_rendered_sql('text', CODE_LINES)} AS text, lang, source AS zone, source AS author, "
            "(DATE '2024-01-01' + (n_chars % 30)::INT)::DATE AS mtime, doc_id FROM documents)")
CODE_LINES_SQL = (CODE_SQL + ", cl AS (SELECT path, lang, zone, doc_id, unnest(l) AS raw, "
                  "unnest(range(1, len(l) + 1)) AS line_no FROM "
                  "(SELECT *, string_split(text, chr(10)) AS l FROM code)), "
                  "sl AS (SELECT *, regexp_replace(raw, '(^|[ \\t])//.*$', '') AS line FROM cl)")


def test_files(t: Tables) -> DataFrame:
    """A test file for every document that was labelled good."""
    good = t.labels.filter("quality = 1").select("doc_id").distinct()
    return t.documents.join(good, "doc_id", "left_semi").select(
        F.concat(F.lit("tests/"), "source", F.lit("/doc_"), "doc_id", F.lit(".test.ts")).alias("path"),
        _rendered(F.col("text"), TEST_LINES).alias("text"), "lang",
        F.col("source").alias("zone"), "doc_id")


TESTS_SQL = (f"tests AS (SELECT 'tests/' || source || '/doc_' || doc_id || '.test.ts' AS path, "
             f"{_rendered_sql('text', TEST_LINES)} AS text, lang, source AS zone, doc_id FROM documents "
             "WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))")


def head_files(t: Tables) -> DataFrame:
    """A later version of the code: bad files gain a line, toxic ones go, benchmark items arrive."""
    verdicts = t.labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    kept = (code_files(t).join(verdicts, "doc_id", "left")
            .filter(F.coalesce(F.col("toxic"), F.lit(0)) == 0)
            .select("path", F.when(F.col("quality") == 0, F.concat("text", F.lit("\n" + ADDED_LINE)))
                    .otherwise(F.col("text")).alias("text"), "lang", "zone"))
    added = t.benchmark.select(
        F.concat(F.lit("src/bench/item_"), "item_id", F.lit(".ts")).alias("path"),
        _rendered(F.col("text"), CODE_LINES).alias("text"), F.lit("en").alias("lang"), F.lit("bench").alias("zone"))
    return kept.unionByName(added)


HEAD_SQL = (CODE_SQL + ", verdicts AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY 1), "
            "head AS (SELECT path, CASE WHEN quality = 0 THEN text || chr(10) || " + sql_text(ADDED_LINE) +
            " ELSE text END AS text, lang, zone FROM code LEFT JOIN verdicts USING (doc_id) WHERE coalesce(toxic, 0) = 0 "
            "UNION ALL SELECT 'src/bench/item_' || item_id || '.ts', " + _rendered_sql("text", CODE_LINES) +
            ", 'en', 'bench' FROM benchmark)")


def zone_registry(t: Tables) -> DataFrame:
    """Path prefix -> zone and role, from the nations and their regions."""
    folders = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("src/src"), "n_nationkey").alias("prefix"), F.col("r_name").alias("zone"),
        F.when(F.col("r_regionkey") == 0, "thin").when(F.col("r_regionkey") == 1, "generic")
        .otherwise("domain").alias("role"))
    root = t.region.agg(F.lit("src").alias("prefix"), F.lit("ROOT").alias("zone"), F.lit("generic").alias("role"))
    return folders.unionByName(root)


ZONES_SQL = ("zones AS (SELECT 'src/src' || n_nationkey AS prefix, r_name AS zone, CASE r_regionkey WHEN 0 THEN 'thin' "
             "WHEN 1 THEN 'generic' ELSE 'domain' END AS role FROM nation JOIN region ON n_regionkey = r_regionkey "
             "UNION ALL SELECT 'src', 'ROOT', 'generic')")


def allowed_pairs(t: Tables) -> DataFrame:
    """A zone may use itself and the next region's zone."""
    following = t.region.select((F.col("r_regionkey") - 1).alias("r_regionkey"), F.col("r_name").alias("dst_zone"))
    nxt = t.region.join(following, "r_regionkey").select(F.col("r_name").alias("src_zone"), "dst_zone")
    return nxt.unionByName(t.region.select(F.col("r_name").alias("src_zone"), F.col("r_name").alias("dst_zone")))


ALLOWED_SQL = ("allowed AS (SELECT a.r_name AS src_zone, b.r_name AS dst_zone FROM region a JOIN region b "
               "ON b.r_regionkey = a.r_regionkey + 1 UNION ALL SELECT r_name, r_name FROM region)")


def history(t: Tables) -> DataFrame:
    """Change history: every event is one change of one entity by one author."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    return t.events.select(
        F.col("event_id"), F.concat(F.lit("u"), "user_id").alias("author"),
        F.concat(F.lit("src/src"), (k % 20).cast("string"), F.lit("/doc_"), k.cast("string")).alias("entity"),
        F.concat(F.lit("src"), (k % 20).cast("string")).alias("zone"),
        F.col("event_type").alias("kind"), F.col("ts").alias("changed_at"), "value")


HISTORY_SQL = ("history AS (SELECT event_id, 'u' || user_id AS author, 'src/src' || (k % 20) || '/doc_' || k AS entity, "
               "'src' || (k % 20) AS zone, event_type AS kind, ts AS changed_at, value FROM "
               "(SELECT *, regexp_extract(props, '[0-9]+')::INT AS k FROM events))")

EVENT_AXES = {"signup": 1, "click": 2, "view": 3, "error": 4, "purchase": 5}


def _event_axis():
    column = F.lit(6)
    for kind, axis in EVENT_AXES.items():
        column = F.when(F.col("event_type") == kind, F.lit(axis)).otherwise(column)
    return column


def trend_records(t: Tables) -> DataFrame:
    """One trend record per event: its value spells the severity counts."""
    whole = F.floor("value").cast("bigint")
    return t.events.select(
        F.concat(F.lit("r"), "event_id").alias("record_id"), F.col("event_id").alias("run_id"),
        F.col("event_id").alias("commit_sha"), F.concat(F.lit("b"), "user_id").alias("branch"),
        F.when(F.col("value") > 20, "branch").otherwise("all").alias("scope"),
        _event_axis().alias("axiom"), F.floor(whole / 100).cast("bigint").alias("error"),
        (F.floor(whole / 10) % 10).cast("bigint").alias("warning"), (whole % 10).alias("info"),
        (F.regexp_extract("props", "[0-9]+", 0).cast("int") / 10.0).alias("kloc"), F.col("ts").alias("recorded_at"))


_AXIS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in EVENT_AXES.items()) + " ELSE 6 END"
TRENDS_SQL = ("trends AS (SELECT 'r' || event_id AS record_id, event_id AS run_id, event_id AS commit_sha, "
              "'b' || user_id AS branch, CASE WHEN value > 20 THEN 'branch' ELSE 'all' END AS scope, "
              f"{_AXIS_SQL} AS axiom, (floor(value)::BIGINT // 100) AS error, "
              "(floor(value)::BIGINT // 10) % 10 AS warning, floor(value)::BIGINT % 10 AS info, "
              "regexp_extract(props, '[0-9]+')::INT / 10.0::DOUBLE AS kloc, ts AS recorded_at FROM events)")


def commits(t: Tables) -> DataFrame:
    """Commit graph: every event is a commit with up to two parents."""
    sha = F.col("event_id")
    first = t.events.select(sha.alias("sha"), F.when(sha > 0, F.floor((sha - 1) / 2).cast("bigint")).alias("parent_sha"))
    second = t.events.filter(sha > 3).select(sha.alias("sha"), F.floor((sha - 1) / 3).cast("bigint").alias("parent_sha"))
    return first.unionByName(second)


COMMITS_SQL = ("commits AS (SELECT event_id AS sha, CASE WHEN event_id > 0 THEN (event_id - 1) // 2 END AS parent_sha FROM events "
               "UNION ALL SELECT event_id, (event_id - 1) // 3 FROM events WHERE event_id > 3)")


def ctes(*parts: str) -> str:
    """``WITH`` clause from CTE strings, each defined once."""
    seen, out = set(), []
    for part in parts:
        for piece in split_ctes(part):
            name = piece.split(" AS ", 1)[0].strip()
            if name not in seen:
                seen.add(name)
                out.append(piece)
    return "WITH RECURSIVE " + ", ".join(out) + " "


def split_ctes(part: str) -> list[str]:
    pieces, depth, quoted, start = [], 0, False, 0
    for i, ch in enumerate(part):
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch == "(":
            depth += 1
        elif not quoted and ch == ")":
            depth -= 1
        elif not quoted and ch == "," and depth == 0:
            pieces.append(part[start:i].strip())
            start = i + 1
    pieces.append(part[start:].strip())
    return pieces
