"""Rules on small files: one that breaks the rule, one that does not."""

import pytest

from corpus_audit.operators import duplicates, findings, packs, rules

CASES = [
    ("RUL-01", "src/a.ts", "const DB_PASSWORD = 'hunter2hunter2';", "const password = readSecret();"),
    ("RUL-02", "src/a.ts", "return `https://x.example/cb?token=${t}`;", "return `https://x.example/cb?page=${t}`;"),
    ("RUL-03", "src/a.ts", "crypto.createHash('md5')", "crypto.createHash('sha256')"),
    ("RUL-05-eval", "src/a.js", "eval(body)", "medieval(body)"),
    ("RUL-05-html", "src/a.js", "node.innerHTML = x", "node.textContent = x"),
    ("RUL-05-load", "src/a.py", "pickle.loads(blob)", "json.loads(blob)"),
    ("RUL-06", "src/a.ts", "console.log('login', token)", "console.log('login', id)"),
    ("RUL-07-server", "src/a.ts", "console.log('x')", "logger.info('x')"),
    ("RUL-07-ui", "src/a.tsx", "console.log('x')", "blueprint('x')"),
    ("RUL-08", "src/a.ts", "res.status(500).send(err.stack)", "res.status(500).send('failed')"),
    ("RUL-09", "src/a.ts", "start({ debug: true })", "start({ debug: false })"),
    ("RUL-11", "src/a.ts", "skipper = ctx.query.skipper", "skipper = session.skipper"),
    ("RUL-13-ts", "src/a.ts", "function f(x: any) {}", "function f(x: anyone) {}"),
    ("RUL-13-py", "src/a.py", "x = f()  # type: ignore", "x = f()"),
    ("RUL-13-go", "src/a.go", "func f(x interface{}) {}", "func f(x string) {}"),
    ("RUL-17-sync", "src/a.ts", "fs.readFileSync(p)", "await fs.readFile(p)"),
    ("RUL-17-unbounded", "src/a.ts", "await Promise.all(rows.map(load))", "await pool(rows, load)"),
    ("RUL-17-timeout", "src/a.ts", "fetch(url)", "prefetched(url"),
    ("RUL-19", "src/a.tsx", "localStorage.setItem('token', t)", "localStorage.setItem('theme', t)"),
    ("RUL-24-email", "docs/a", "write to ann@mail.example.org today", "write to ann at example"),
    ("RUL-24-phone", "docs/a", "call +1 (212) 555-0100 now", "call 2125550100 now"),
    ("RUL-24-ip", "docs/a", "host 10.20.30.40 is up", "version 10.20.30 is up"),
]


def corpus(spark, *files):
    return spark.createDataFrame(list(files), "path string, text string")


@pytest.mark.parametrize("rule_id,path,bad,good", CASES)
def test_line_rule(spark, rule_id, path, bad, good):
    pack = [r for r in packs.pack() if r.rule_id == rule_id]
    found = rules.scan_rules(corpus(spark, (path, f"first\n{bad}\nlast"), (path + "2", f"first\n{good}\nlast")), pack).collect()
    assert [(f.path, f.line_start) for f in found] == [(path, 2)]


def test_every_rule_has_a_case():
    assert {c[0] for c in CASES} == {r.rule_id for r in packs.pack()}


def test_leaks_count_in_comments_and_prose_is_never_cut(spark):
    files = corpus(spark, ("src/a.ts", "run(); // const API_KEY = 'harbour-plum-7'"), ("docs/b", "see // mail ann@mail.example.org"))
    assert sorted(r.rule_id for r in rules.scan_rules(files, packs.pack()).collect()) == ["RUL-01", "RUL-24-email"]


def test_a_pack_may_have_any_number_of_rules(spark):
    many = [packs.Rule(f"R{n}", 1, "Low", None, f"word{n}$", "m") for n in range(300)]
    files = corpus(spark, ("a", "\n".join(f"word{n}" for n in range(0, 300, 7))))
    found = rules.scan_rules(files, packs.load_pack(packs.rule_table(spark, many)))
    assert {r.rule_id for r in found.collect()} == {f"R{n}" for n in range(0, 300, 7)}


def test_a_log_call_that_dumps_an_object(spark):
    files = corpus(spark, ("src/a.ts", "console.log('in', JSON.stringify(cargo))\nconsole.log(request)\nconsole.log(requested)"))
    assert [r.line_start for r in rules.scan_rules(files, packs.pack("RUL-06")).collect()] == [1, 2]


def test_comments_do_not_count(spark):
    files = corpus(spark, ("src/a.ts", "run(); // eval(x) and console.log(y)\nconst u = 'https://a.example/b';"))
    assert rules.scan_rules(files, packs.pack()).count() == 0


def test_empty_and_crlf_files(spark):
    files = corpus(spark, ("src/a.ts", ""), ("src/b.ts", "let a;\r\neval(x);\r\n"))
    assert [(r.path, r.line_start) for r in rules.scan_rules(files, packs.pack("RUL-05")).collect()] == [("src/b.ts", 2)]
    assert rules.explode_lines(files).filter("path = 'src/b.ts'").count() == 3


def test_interpolated_sql_spans_the_call(spark):
    text = "x\nawait db.query(\n  `SELECT a FROM t WHERE id = ${id}`\n);\ndb.query('SELECT a FROM t WHERE id = ?', [id]);"
    assert [(r.line_start, r.line_end) for r in rules.interpolated_sql(corpus(spark, ("a.ts", text))).collect()] == [(2, 3)]


def test_unguarded_access(spark):
    route = "server.put('/berths/7', dock);"
    files = corpus(spark, ("a.ts", "\n" + route), ("b.ts", route + "\nrequireAuth(call);"))
    assert [(r.path, r.line_start) for r in rules.unguarded_access(files).collect()] == [("a.ts", 2)]


def test_accessibility(spark):
    text = ("<button onClick={() => go()}>\n<button aria-label=\"Go\" onClick={go}>\n<li onClick={() => go()}>\n"
            "<li role=\"button\" onKeyDown={go} onClick={go}>")
    assert sorted(r.line_start for r in rules.a11y_tags(corpus(spark, ("a.tsx", text))).collect()) == [1, 3]


def test_fixed_width(spark):
    text = "minWidth: '940px'\nwidth: '600px'\nmax-width=\"601px\""
    assert sorted(r.line_start for r in rules.fixed_width(corpus(spark, ("a.tsx", text))).collect()) == [1, 3]


def test_list_without_key(spark):
    text = "rows.map((r) => (\n  <li>{r}</li>\n))\nrows.map((r) => (\n  <li key={r}>{r}</li>\n))\nrows.map(f)\n1\n2"
    assert [r.line_start for r in rules.list_without_key(corpus(spark, ("a.tsx", text))).collect()] == [1]


def test_query_in_loop(spark):
    text = "for (const r of rows) {\n a\n db.query(r)\n}\n1\n2\n3\ndb.query(x)"
    assert [r.line_start for r in rules.query_in_loop(corpus(spark, ("a.ts", text))).collect()] == [3]


def test_stale_artifacts_are_strictly_older(spark):
    files = spark.createDataFrame([("plan.md", "2024-01-01"), ("spec-x.md", "2024-01-02"), ("readme.md", "2020-01-01")], "path string, mtime string")
    assert [(r.path, r.age_days) for r in rules.stale_artifacts(files, "2024-01-09").collect()] == [("plan.md", 8)]


def test_comment_blocks(spark):
    text = "// a = 1;\n// b();\n// c = {};\ncode\n// d();\n// words only"
    assert [(r.line_start, r.line_end) for r in rules.comment_blocks(corpus(spark, ("a.ts", text))).collect()] == [(1, 3)]


def test_unreleased(spark):
    files = corpus(spark, ("a.ts", "setInterval(f, 1)"), ("b.ts", "setInterval(f, 1)\nclearInterval(t)"))
    assert [r.path for r in rules.unreleased(files).collect()] == ["a.ts"]


def test_unused_imports(spark):
    text = "import React, { useState } from 'react';\nimport axios from 'axios'; // axios\nimport { a as b } from './c';\nuseState(b);"
    assert [(r.line_start, r.symbol) for r in duplicates.unused_imports(corpus(spark, ("a.tsx", text))).collect()] == [(2, "axios")]


def test_ids_survive_moved_lines(spark):
    body = "eval(x);\nconsole.log('a');\neval(x);"
    def ids(text):
        hits = rules.rule_hits(corpus(spark, ("src/a.ts", text)), packs.pack())
        with_context = rules.as_findings(hits.withColumnRenamed("line", "context"), keep=("context",))
        return {r.finding_id for r in findings.with_finding_id(with_context).collect()}
    assert ids(body) == ids("// moved\n\n" + body)
    assert len(ids(body)) == 3


def test_clean_corpus_gives_nothing(spark):
    assert rules.scan_rules(corpus(spark, ("src/a.ts", "export const a = 1;\n")), packs.pack()).count() == 0
