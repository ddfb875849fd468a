"""Imports as they are written: over several lines, renamed, as a whole, and in Python."""

from corpus_audit.operators import graph

FILES = [
    ("app/main.ts", "import {\n  alpha,\n  beta as gamma,\n} from './lib'\nimport whole, { part } from './mix'\nimport * as space from './space'\n"
                    "import './side'\nimport type { Shape } from '@/types'\nimport pkg from 'pkg'\n"),
    ("app/lib.ts", "export { one as alpha } from './deep/one'\nexport {\n  two,\n  beta\n} from './deep/two'\nexport * from './stars'\n"),
    ("app/deep/one.ts", "export const one = 1"), ("app/deep/two.ts", "export const two = 2\nexport const beta = 3"),
    ("app/stars.ts", "export * from './deep/far'"), ("app/deep/far.ts", "export const far = 4"),
    ("app/mix.ts", "export default 1"), ("app/space.ts", ""), ("app/side.ts", ""), ("src/types.ts", ""),
    ("py/pack/run.py", "from .tools import hammer, saw as blade\nfrom ..base import (\n    plank,\n    nail,\n)\nfrom py.base import beam\nfrom numpy import array\n"),
    ("py/pack/tools.py", ""), ("py/base.py", ""),
]


def files(spark):
    return spark.createDataFrame(FILES, "path string, text string")


def resolved(spark):
    return graph.resolve_edges(graph.extract_symbol_edges(files(spark)), files(spark), [("@/", "src/")])


def test_every_statement_is_an_edge(spark):
    edges, status = graph.resolve_edges(graph.extract_edges(files(spark)), files(spark), [("@/", "src/")])
    assert {(e.src, e.dst, e.kind) for e in edges.collect()} == {
        ("app/main.ts", "app/lib.ts", "import"), ("app/main.ts", "app/mix.ts", "import"), ("app/main.ts", "app/space.ts", "import"),
        ("app/main.ts", "app/side.ts", "import"), ("app/main.ts", "src/types.ts", "import"), ("app/lib.ts", "app/deep/one.ts", "reexport"),
        ("app/lib.ts", "app/deep/two.ts", "reexport"), ("app/lib.ts", "app/stars.ts", "reexport"), ("app/stars.ts", "app/deep/far.ts", "reexport"),
        ("py/pack/run.py", "py/pack/tools.py", "pyimport"), ("py/pack/run.py", "py/base.py", "pyimport")}
    assert {(e.src, e.spec, e.reason) for e in status.filter("dst is null").collect()} == {
        ("app/main.ts", "pkg", "external"), ("py/pack/run.py", "numpy", "external")}


def test_names_are_those_of_the_other_module(spark):
    edges, _ = resolved(spark)
    assert {(e.dst, e.symbol, e.name) for e in edges.filter("src = 'app/main.ts'").collect()} == {
        ("app/lib.ts", "alpha", "alpha"), ("app/lib.ts", "beta", "gamma"), ("app/mix.ts", "default", "whole"), ("app/mix.ts", "part", "part"),
        ("app/space.ts", "*", "space"), ("src/types.ts", "Shape", "Shape")}
    assert {(e.dst, e.symbol, e.name) for e in edges.filter("src = 'py/pack/run.py'").collect()} == {
        ("py/pack/tools.py", "hammer", "hammer"), ("py/pack/tools.py", "saw", "blade"), ("py/base.py", "plank", "plank"),
        ("py/base.py", "nail", "nail"), ("py/base.py", "beam", "beam")}


def test_barrels_rename_and_pass_on_stars(spark):
    from corpus_audit.operators import duplicates
    edges, _ = resolved(spark)
    reexports = edges.filter("kind = 'reexport'").selectExpr("src AS barrel", "name AS symbol", "dst AS target", "symbol AS source")
    reexports = graph.expand_stars(reexports, duplicates.exports(files(spark)))
    asked = spark.createDataFrame([("x", "app/lib.ts", "alpha"), ("x", "app/lib.ts", "two"), ("x", "app/lib.ts", "far"), ("x", "app/lib.ts", "none")],
                                  "src string, dst string, symbol string")
    assert {(e.dst, e.symbol) for e in graph.flatten_barrels(asked, reexports).collect()} == {
        ("app/deep/one.ts", "one"), ("app/deep/two.ts", "two"), ("app/deep/far.ts", "far"), ("app/lib.ts", "none")}
    both = spark.createDataFrame([("b", "n", "t1"), ("b", "n", "t2"), ("b", "m", "t1")], "barrel string, symbol string, target string")
    assert [tuple(r) for r in graph.ambiguous_reexports(both).collect()] == [("b", "n", 2)]


def test_edges_without_a_zone_are_listed(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d")], "src string, dst string")
    assigned = spark.createDataFrame([("a", "z"), ("b", "z"), ("c", None)], "path string, zone string")
    assert {tuple(r) for r in graph.unzoned_edges(edges, assigned).collect()} == {("a", "c", "target without zone"), ("c", "d", "no zone")}
