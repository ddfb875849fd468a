"""Import and link graphs as edge tables (src, dst, kind)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut_lineage
from .components import components
from .pointers import chain_ends

# Kind of edge and the pattern whose first group is the target.
EDGE_PATTERNS = {
    "import": r"(?m)^[ \t]*import[ \t]+(?:[A-Za-z0-9_$*, \t]*(?:\{[A-Za-z0-9_$,\s]*\})?[ \t]*from[ \t]+)?['\"]([^'\"\n]+)['\"]",
    "reexport": r"(?m)^[ \t]*export[ \t]+(?:type[ \t]+)?(?:\{[A-Za-z0-9_$,\s]*\}|\*(?:[ \t]+as[ \t]+[A-Za-z0-9_$]+)?)[ \t]*from[ \t]+['\"]([^'\"\n]+)['\"]",
    "pyimport": r"(?m)^[ \t]*from[ \t]+([.A-Za-z_][.A-Za-z0-9_]*)[ \t]+import[ \t(]",
    "require": r"\brequire\([ \t]*['\"]([^'\"\n]+)['\"]",
    "dynamic": r"\bimport\([ \t]*['\"]([^'\"\n]+)['\"]",
    "href": r"href=\"([^\"]*)\"",
}
# Statement, default name, braced names, star, target.
SYMBOL_EDGE = (r"(?m)^[ \t]*(import|export)[ \t]+(?:type[ \t]+)?(?:([A-Za-z_$][A-Za-z0-9_$]*)[ \t]*,?[ \t]*)?(?:\{([A-Za-z0-9_$,\s]*)\}|(\*)[A-Za-z0-9_$ \t]*?)?"
               r"[ \t]*from[ \t]+['\"]([^'\"\n]+)['\"]")
PY_SYMBOL_EDGE = r"(?m)^[ \t]*from[ \t]+([.A-Za-z_][.A-Za-z0-9_]*)[ \t]+import[ \t]+(\([^)]*\)|[^\n#;(]+)"
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.tsx", "/index.js", "/__init__.py")


def extract_edges(files: DataFrame, kinds: tuple[str, ...] = tuple(EDGE_PATTERNS)) -> DataFrame:
    """(src, spec, kind): every import-like statement of a file, from its own row."""
    def of_kind(kind: str) -> Column:
        specs = F.regexp_extract_all("text", F.lit(EDGE_PATTERNS[kind]), F.lit(1))
        return F.transform(specs, lambda spec: F.struct(spec.alias("spec"), F.lit(kind).alias("kind")))
    found = F.concat(*[of_kind(kind) for kind in kinds])
    return files.select(F.col("path").alias("src"), F.explode(found).alias("e")).select("src", "e.spec", "e.kind")


def _named(listed: Column) -> Column:
    """(symbol, name) of a list such as ``a, b as c``: the name in the other module and the name here."""
    entries = F.filter(F.transform(F.split(listed, ",", -1), tx.squeeze_all), lambda n: n != "")
    return F.transform(entries, lambda n: F.struct(F.regexp_replace(n, r"^type | as .*$", "").alias("symbol"),
                                                   F.regexp_replace(n, r"^.* as |^type ", "").alias("name")))


def extract_symbol_edges(files: DataFrame) -> DataFrame:
    """(src, spec, kind, symbol, name): one row per name taken from another module, also over several lines.

    ``symbol`` is the name there and ``name`` the one here.  A default import takes ``default``; a namespace import or
    ``export *`` takes ``*``.
    """
    part = lambda n: F.regexp_extract("s", SYMBOL_EDGE, n)
    rows = files.select(F.col("path").alias("src"), F.explode(F.regexp_extract_all("text", F.lit(SYMBOL_EDGE), F.lit(0))).alias("s"))
    pair = lambda symbol, name: F.array(F.struct(F.lit(symbol).alias("symbol"), name.alias("name")))
    nothing = F.expr("cast(array() as array<struct<symbol:string,name:string>>)")
    star = F.coalesce(F.nullif(F.regexp_extract("s", r"\*[ \t]+as[ \t]+([A-Za-z_$][A-Za-z0-9_$]*)", 1), F.lit("")), F.lit("*"))
    taken = F.concat(F.when(part(2) != "", pair("default", part(2))).otherwise(nothing), _named(part(3)),
                     F.when(part(4) != "", pair("*", star)).otherwise(nothing))
    kind = F.when(part(1) == "import", "import").otherwise("reexport")
    script = rows.select("src", part(5).alias("spec"), kind.alias("kind"), F.explode(taken).alias("n"))
    own = lambda n: F.regexp_extract("s", PY_SYMBOL_EDGE, n)
    python = (files.select(F.col("path").alias("src"), F.explode(F.regexp_extract_all("text", F.lit(PY_SYMBOL_EDGE), F.lit(0))).alias("s"))
              .select("src", own(1).alias("spec"), F.lit("pyimport").alias("kind"),
                      F.explode(_named(F.regexp_replace(own(2), r"[()]", ""))).alias("n")))
    return script.unionByName(python).select("src", "spec", "kind", "n.symbol", "n.name")


def package_of(spec: Column) -> Column:
    """Package name of a bare import: ``@scope/name`` or the first segment."""
    return F.regexp_extract(spec, r"^(@[^/]+/[^/]+|[^/]+)", 1)


def package_imports(edges: DataFrame, aliases: list[tuple[str, str]]) -> DataFrame:
    """(src, package) of edges that point outside the corpus."""
    local = F.col("spec").rlike(r"^[./]") | F.col("spec").contains(":")
    for prefix, _ in aliases:
        local |= F.col("spec").startswith(prefix)
    return edges.filter((F.col("kind") != "href") & ~local).select("src", package_of(F.col("spec")).alias("package")).distinct()


def _target(aliases: list[tuple[str, str]]) -> Column:
    """Corpus path an import means, without suffix; null for packages and addresses."""
    spec = F.col("spec")
    # Python counts folders in dots: one for its own, one more for each above.
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    module = F.replace(F.regexp_replace(spec, r"^\.*", ""), F.lit("."), F.lit("/"))
    above = F.concat(F.lit("./"), F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), module)
    target = F.when((F.col("kind") == "pyimport") & (dots > 0), tx.joined_path(tx.parent_dir(F.col("src")), above))
    target = target.when(F.col("kind") == "pyimport", module)
    target = target.when(spec.rlike(r"^\.{1,2}(/|$)"), tx.joined_path(tx.parent_dir(F.col("src")), spec))
    # Longest prefix first, so overlapping aliases go to the most specific one.
    for prefix, path in sorted(aliases, key=lambda pair: -len(pair[0])):
        target = target.when(spec.startswith(prefix), F.concat(F.lit(path), F.substring(spec, F.lit(len(prefix) + 1), F.length(spec))))
    return target.when(spec.startswith("/"), F.regexp_replace(spec, "^/", ""))


def resolve_edges(edges: DataFrame, files: DataFrame, aliases: list[tuple[str, str]] = ()) -> tuple[DataFrame, DataFrame]:
    """(resolved edges, status of all edges).

    ``aliases`` come from a project's configuration and become one expression.  Resolved edges carry
    ``dst``; the status table carries ``reason`` for those that found no file.
    """
    aimed = edges.withColumn("target", _target(list(aliases)))
    # Each distinct target is looked up once, whatever number of edges point to it.
    targets = aimed.select("target").filter("target is not null").distinct()
    candidates = F.array(*[F.struct(F.lit(rank).alias("rank"), F.concat("target", F.lit(suffix)).alias("path"))
                           for rank, suffix in enumerate(SUFFIXES)])
    found = (targets.select("target", F.explode(candidates).alias("c")).select("target", "c.rank", "c.path")
             .join(files.select("path").distinct(), "path", "left_semi")
             .groupBy("target").agg(F.min_by("path", "rank").alias("dst")))
    # Edges without a target all share the null key and need no lookup: they pass by the join.
    outside = aimed.filter("target is null").withColumn("dst", F.lit(None).cast("string"))
    looked_up = aimed.filter("target is not null").join(found, "target", "left")
    elsewhere = F.col("target").isNull() | ((F.col("kind") == "pyimport") & F.col("dst").isNull() & ~F.col("spec").startswith("."))
    status = looked_up.unionByName(outside).withColumn(
        "reason", F.when(elsewhere, "external").when(F.col("dst").isNull(), "no such file"))
    resolved = status.filter("dst is not null").drop("target", "reason")
    return resolved, status.drop("target")


def coverage(status: DataFrame) -> DataFrame:
    """One row: share of corpus-internal edges that resolved, and why others did not."""
    internal = F.coalesce(F.col("reason"), F.lit("")) != "external"
    counts = status.agg(
        F.count_if(internal).alias("internal"), F.count_if(F.col("dst").isNotNull()).alias("resolved"),
        F.count_if(F.col("reason") == "no such file").alias("unresolved"),
        F.count_if(F.col("reason") == "external").alias("external"))
    return counts.withColumn("coverage", F.round(F.col("resolved") / F.nullif("internal", F.lit(0)), 6))


def _barrel_ends(reexports: DataFrame) -> DataFrame:
    """(barrel, symbol, target, ring): where each re-exported name is finally defined."""
    source = F.col("source") if "source" in reexports.columns else F.col("symbol")
    first = (reexports.filter("barrel <> target").withColumn("source", source)
             .groupBy("barrel", "symbol").agg(F.min(F.struct("target", "source")).alias("to")))
    ends = chain_ends(first.select(F.struct(F.col("barrel").alias("path"), "symbol").alias("key"),
                                   F.struct(F.col("to.target").alias("path"), F.col("to.source").alias("symbol")).alias("next")))
    return ends.select(F.col("key.path").alias("barrel"), "key.symbol", F.col("end.path").alias("target"),
                       F.col("end.symbol").alias("source"), "ring")


def ambiguous_reexports(reexports: DataFrame) -> DataFrame:
    """(barrel, symbol, targets): names that a barrel takes from several modules; only the first by path is followed."""
    return (reexports.groupBy("barrel", "symbol").agg(F.count_distinct("target").alias("targets")).filter("targets > 1"))


def flatten_barrels(edges: DataFrame, reexports: DataFrame) -> DataFrame:
    """Edges (src, dst, symbol) moved from re-exporting files to the defining ones.

    ``reexports(barrel, symbol, target[, source])``: a barrel offers ``symbol``, which is called ``source`` in the target.
    Names that are only passed around keep the edge they had.
    """
    ends = _barrel_ends(reexports).filter("not ring").select(F.col("barrel").alias("dst"), "symbol", "target", "source")
    return (edges.join(ends, ["dst", "symbol"], "left")
            .withColumn("symbol", F.coalesce("source", "symbol"))
            .withColumn("dst", F.coalesce("target", "dst")).select(*edges.columns))


def expand_stars(reexports: DataFrame, exported: DataFrame) -> DataFrame:
    """``reexports`` with every ``*`` row replaced by one row for each name its target offers, its own stars included.

    ``exported(path, symbol)`` are the names that files define.  A round passes names on by one barrel.
    """
    stars = reexports.filter("symbol = '*'").select("barrel", "target").distinct()
    plain = reexports.filter("symbol <> '*'").select("barrel", "symbol", "target", "source")
    offered = cut_lineage(exported.select("path", "symbol").unionByName(plain.select(F.col("barrel").alias("path"), "symbol")).distinct())
    found = None
    while True:
        passed = stars.join(offered.withColumnRenamed("path", "target"), "target").filter("symbol <> 'default' and barrel <> target")
        fresh = cut_lineage(passed.select(F.col("barrel").alias("path"), "symbol").distinct().join(offered, ["path", "symbol"], "left_anti"))
        found = passed
        if fresh.isEmpty():
            break
        offered = cut_lineage(offered.unionByName(fresh))
    own = exported.select(F.col("path").alias("barrel"), "symbol")
    spread = found.select("barrel", "symbol", "target", F.col("symbol").alias("source")).join(own, ["barrel", "symbol"], "left_anti")
    return plain.unionByName(spread).distinct()


def barrel_rings(reexports: DataFrame) -> DataFrame:
    """(barrel, symbol) of names that no file defines: the re-exports run in a ring."""
    return _barrel_ends(reexports).filter("ring").select("barrel", "symbol")


def _distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def fan_in_out(edges: DataFrame) -> DataFrame:
    """(module, fan_in, fan_out) over distinct edges, in one aggregation."""
    ends = F.array(F.struct(F.col("src").alias("module"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                   F.struct(F.col("dst").alias("module"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return (_distinct_edges(edges).select(F.explode(ends).alias("e")).groupBy("e.module")
            .agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out")))


def assign_zone(files: DataFrame, zones: DataFrame) -> DataFrame:
    """(path, prefix, zone, role): longest path prefix registered in ``zones(prefix, zone, role)``.

    Prefixes are looked up once per folder by an equi join; files then join their folder.
    """
    placed = files.select("path").distinct().withColumn("folder", tx.parent_dir(F.col("path")))
    parts = F.split("folder", "/", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = placed.select("folder").distinct().select("folder", F.explode(prefixes).alias("prefix"))
    best = (folders.join(zones.dropDuplicates(["prefix"]), "prefix").groupBy("folder")
            .agg(F.max_by(F.struct("prefix", "zone", "role"), F.length("prefix")).alias("z")))
    return placed.join(best, "folder", "left").select("path", "z.prefix", "z.zone", "z.role")


def zone_edges(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """(src, dst, src_zone, dst_zone) for distinct edges between zoned modules."""
    zone = assigned.filter("zone is not null").select("path", "zone")
    return (_distinct_edges(edges)
            .join(zone.select(F.col("path").alias("src"), F.col("zone").alias("src_zone")), "src")
            .join(zone.select(F.col("path").alias("dst"), F.col("zone").alias("dst_zone")), "dst"))


def unzoned_edges(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """(src, dst, reason): edges that no boundary rule can judge, because one of their ends has no zone."""
    zone = assigned.filter("zone is not null").select("path", F.lit(True).alias("zoned"))
    ends = (_distinct_edges(edges)
            .join(zone.select(F.col("path").alias("src"), F.col("zoned").alias("s")), "src", "left")
            .join(zone.select(F.col("path").alias("dst"), F.col("zoned").alias("d")), "dst", "left"))
    reason = F.when(F.col("s").isNull() & F.col("d").isNull(), "no zone").when(F.col("s").isNull(), "source without zone").when(
        F.col("d").isNull(), "target without zone")
    return ends.withColumn("reason", reason).filter("reason is not null").select("src", "dst", "reason")


def boundary_breaches(edges: DataFrame, assigned: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges whose zone pair is not in ``allowed(src_zone, dst_zone)``."""
    return zone_edges(edges, assigned).join(allowed, ["src_zone", "dst_zone"], "left_anti")


def zone_adjacency(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """(src_zone, dst_zone, edges)."""
    return zone_edges(edges, assigned).groupBy("src_zone", "dst_zone").agg(F.count(F.lit(1)).alias("edges"))


def misplaced(files: DataFrame, layout: DataFrame) -> DataFrame:
    """Files whose kind belongs into another zone: ``files(path, kind, zone)``, ``layout(kind, zone)``."""
    home = layout.select("kind", F.col("zone").alias("expected_zone"))
    return files.join(home, "kind").filter("zone <> expected_zone").select("path", "kind", "zone", "expected_zone")


def _core(edges: DataFrame) -> DataFrame:
    """Drop edges of modules without a way in or without a way out."""
    return (edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            .join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))


def _stretches(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, head, tail) of modules with one way in and one way out, and (module, component) of bare rings.

    Head and tail are the modules at which the stretch of such modules begins and ends.  Pointers double their reach
    every round, so a stretch costs rounds by the logarithm of its length.
    """
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("next")).filter("n = 1")
    into = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("prev")).filter("n = 1")
    single = cut_lineage(out.select(F.col("src").alias("key"), "next")
                         .join(into.select(F.col("dst").alias("key"), "prev"), "key"))
    if single.isEmpty():
        return single.select(F.col("key").alias("node"), F.col("prev").alias("head"), F.col("next").alias("tail")), None
    tails = chain_ends(single.select("key", "next"))
    heads = chain_ends(single.select("key", F.col("prev").alias("next")))
    ring = cut_lineage(tails.filter("ring").select("key").join(single.select("key", "next"), "key"))
    rings = None if ring.isEmpty() else components(ring, "key", "next").select(F.col("node").alias("module"), "component")
    spans = (tails.filter("NOT ring").select(F.col("key").alias("node"), F.col("end").alias("tail"))
             .join(heads.select(F.col("key").alias("node"), F.col("end").alias("head")), "node").select("node", "head", "tail"))
    return cut_lineage(spans), rings


def _contracted(edges: DataFrame) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """What is left of ``edges`` without dead ends and stretches, the stretches taken out round by round, and the rings met.

    A stretch is replaced by an edge from its head to its tail, which may make a new loop, dead end or stretch.  As long as dead
    ends alone halve the graph, they are all that leaves it.
    """
    taken, rings = [], []
    size = edges.count()
    while size:
        edges = cut_lineage(_core(edges))
        before, size = size, edges.count()
        if size <= before / 2:
            continue
        spans, ring = _stretches(edges)
        if ring is not None:
            rings.append(ring)
        inner = spans.select(F.col("node").alias("src")) if ring is None else spans.select(F.col("node").alias("src")).union(
            ring.select("module"))
        if not inner.isEmpty():
            taken.append(spans)
            edges = cut_lineage(edges.join(inner, "src", "left_anti")
                                .join(inner.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst")
                                .union(spans.filter("head <> tail").select("head", "tail")).distinct())
            size = edges.count()
        if size == before:
            break
    return edges, taken, rings


def _smallest_reaching(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Smallest label that reaches each node (node, label), the node's own included."""
    while True:
        offered = (edges.join(labels, edges.src == labels.node).groupBy("dst").agg(F.min("label").alias("offer")))
        moved = cut_lineage(labels.join(offered, labels.node == offered.dst, "left").select(
            "node", F.least("label", F.coalesce("offer", "label")).alias("label"),
            F.coalesce(F.col("offer") < F.col("label"), F.lit(False)).alias("moved")))
        labels = moved.select("node", "label")
        if moved.filter("moved").isEmpty():
            return labels


def cycles(edges: DataFrame) -> DataFrame:
    """(module, component): modules that reach themselves, named by the smallest module of the cycle.

    Dead ends and stretches without a fork leave the graph first.  Each round then finds, for every start, the smallest module that
    reaches it; a module that carries its own name is the smallest of its cycle group, and the group is whatever of its colour
    reaches back to it.  Found groups leave the graph.  Stretches come back from the last round to the first: their modules are
    in a cycle if head and tail are in the same.  Nothing ever lists pairs of modules.
    """
    edges = cut_lineage(_distinct_edges(edges))
    loops = edges.filter("src = dst").select(F.col("src").alias("module"))
    rest, taken, found = _contracted(edges.filter("src <> dst"))
    while not rest.isEmpty():
        nodes = rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct()
        colour = _smallest_reaching(rest, nodes.withColumn("label", F.col("node")))
        # Walk backwards from each root inside its colour.
        same = cut_lineage(rest.join(colour.select(F.col("node").alias("src"), F.col("label").alias("cs")), "src")
                           .join(colour.select(F.col("node").alias("dst"), F.col("label").alias("cd")), "dst")
                           .filter("cs = cd").select("src", "dst", F.col("cs").alias("colour")))
        member = cut_lineage(colour.filter("node = label").select("node", F.col("label").alias("component")))
        fresh = member
        while True:
            back = (same.join(fresh.select(F.col("node").alias("dst"), F.col("component").alias("colour")), ["dst", "colour"])
                    .select(F.col("src").alias("node"), F.col("colour").alias("component")).distinct())
            fresh = cut_lineage(back.join(member, ["node", "component"], "left_anti"))
            if fresh.isEmpty():
                break
            member = cut_lineage(member.unionByName(fresh))
        group = member.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
        found.append(member.join(group, "component").select(F.col("node").alias("module"), "component"))
        rest = (rest.join(member.select(F.col("node").alias("src")), "src", "left_anti")
                .join(member.select(F.col("node").alias("dst")), "dst", "left_anti"))
        # Earlier rounds' heads and tails are modules of later rounds, so stretches stay in the order they were taken.
        rest, more, rings = _contracted(cut_lineage(rest.select("src", "dst")))
        taken, found = taken + more, found + rings
    known = reduce(DataFrame.unionByName, found) if found else loops.select("module", F.col("module").alias("component")).limit(0)
    for spans in reversed(taken):
        # A stretch that comes back to its head makes a cycle of its own where the head is in no larger one.
        turned = spans.filter("head = tail").select(F.col("head").alias("module")).distinct()
        known = known.unionByName(turned.join(known, "module", "left_anti").withColumn("component", F.col("module")))
        inside = (spans.join(known.select(F.col("module").alias("head"), "component"), "head")
                  .join(known.select(F.col("module").alias("tail"), F.col("component").alias("other")), "tail")
                  .filter("component = other").select(F.col("node").alias("module"), "component"))
        known = cut_lineage(known.unionByName(inside))
    names = known.groupBy("component").agg(F.min("module").alias("name"))
    grouped = known.join(names, "component").select("module", F.col("name").alias("component"))
    return grouped.unionByName(loops.withColumn("component", F.col("module")).join(grouped, "module", "left_anti"))


def blast_radius(edges: DataFrame, changed: DataFrame, depth: int) -> DataFrame:
    """(module, distance): modules that depend on a changed module within ``depth`` steps.

    ``edges`` say src uses dst, so the change travels from dst to src.
    """
    step = cut_lineage(_distinct_edges(edges).select(F.col("dst").alias("module"), F.col("src").alias("user")))
    reached = cut_lineage(changed.select("module").distinct().withColumn("distance", F.lit(0)))
    fresh = reached
    for distance in range(1, depth + 1):
        users = fresh.join(step, "module").select(F.col("user").alias("module")).distinct()
        fresh = cut_lineage(users.join(reached, "module", "left_anti").withColumn("distance", F.lit(distance)))
        if fresh.isEmpty():
            break
        reached = cut_lineage(reached.unionByName(fresh))
    return reached


def graph_digest(edges: DataFrame) -> DataFrame:
    """One row that is equal for equal edge sets, whatever their order: count and sum of edge hashes."""
    distinct = edges.select("src", "dst", "kind").distinct()
    return distinct.agg(
        F.count(F.lit(1)).alias("edges"),
        F.coalesce(F.sum(tx.hash60(F.concat_ws("|", "src", "dst", "kind")).cast("decimal(38,0)")), F.lit(0))
        .cast("string").alias("digest"))


def ordered_edges(edges: DataFrame) -> DataFrame:
    """The graph in a fixed total order, for export."""
    return edges.select("src", "dst", "kind").distinct().orderBy("src", "dst", "kind")
