import pandas as pd
import pytest
from pyspark.sql import functions as F

from weft.operators import edgerules, hunks, reports, trees, validation


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def edges(df):
    return {(r.src, r.dst, r.kind, r.weight, r.evidence) for r in df.collect()}


def test_every_violation_is_named(spark):
    u = spark.createDataFrame(
        [(1, x, x, "p", "a", n, 0, False, False) for x, n in (("a", 5), ("a", 5), ("b", 900), ("c", 1), ("d", 1))],
        "cs_id int, unit_id string, file string, package string, area string, added long, deleted long, is_test boolean, is_generated boolean",
    )
    e = spark.createDataFrame([(1, "a", "b", "must_with", 100), (1, "b", "a", "before", 90), (1, "b", "a", "before", 90), (1, "c", "c", "before", 1), (1, "c", "zz", "before", 1)], "cs_id int, src string, dst string, kind string, weight int")
    m = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 1), (1, "c", 2), (1, "y", 1)], "cs_id int, unit_id string, grp int")
    totals = spark.createDataFrame([(1, 1, 0, 0, 1)], "cs_id int, grp int, added long, deleted long, files long")
    needs = spark.createDataFrame([(1, 1, 2), (1, 2, 2)], "cs_id int, grp int, needs int")
    got = {(r.rule, r.item) for r in validation.plan_violations(u, e, m, totals, needs).collect()}
    assert got >= {
        ("unit-repeated", "a"), ("edge-repeated", "b>a"), ("edge-to-itself", "c>c"), ("end-unknown", "zz"), ("unit-left-out", "d"), ("unit-in-two-groups", "c"), ("member-unknown", "y"),
        ("hard-edge-cut", "a>b"), ("order-inverted", "b>a"), ("group-too-large", "2"), ("totals-differ", "1"), ("totals-differ", "2"), ("dependency-unfounded", "2<2"), ("dependency-not-earlier", "2<2"), ("dependency-not-earlier", "2<1"),
    }
    empty = [x.limit(0) for x in (u, e, m, totals, needs)]
    assert validation.plan_violations(*empty).count() == 0


def test_field_changes(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "x", 4), (2, "y", 1), (4, "z", 1)], "k int, s string, n int")
    assert rows(validation.field_changes(a, b, ["k"])) == [(1, "n", None, "4"), (3, None, "true", "false"), (4, None, "false", "true")]


def test_trees(spark):
    base = spark.createDataFrame([(1, p, p, "100644") for p in "abcd"], "cs_id int, path string, oid string, mode string")
    change = spark.createDataFrame([(1, "f1", "a", None, None, None), (1, "f2", "b", "e", "b", "100644"), (1, "f3", "c", "c", "C", "100755"), (1, "f4", None, "g", "g", "100644")], "cs_id int, file_id string, old_path string, new_path string, new_oid string, new_mode string")
    head = trees.reconstruct(base, change)
    assert [(r.path, r.oid) for r in head.orderBy("path").collect()] == [("c", "C"), ("d", "d"), ("e", "b"), ("g", "g")]
    assert trees.difference(head, head).count() == 0
    assert [r.path for r in trees.reconstruct(base, change, change.where("file_id = 'f1'")).orderBy("path").collect()] == list("bcd")
    assert {(r.path, r.side) for r in trees.difference(base, head).collect()} == {("a", "left"), ("b", "left"), ("c", "left"), ("c", "right"), ("e", "right"), ("g", "right")}


def test_hunks_that_share_or_nest_nodes_are_merged(spark):
    nodes = [(1, "f", "old", "h1", 1, 9), (1, "f", "old", "h2", 3, 5), (1, "f", "new", "h2", 20, 22), (1, "f", "new", "h3", 20, 22), (1, "f", "new", "h4", 30, 31), (1, "g", "new", "h5", 1, 50)]
    df = spark.createDataFrame(nodes, "cs_id int, file string, side string, hunk_id string, start int, end int")
    assert rows(hunks.merged_hunks(df)) == [("h1", "h1"), ("h2", "h1"), ("h3", "h1"), ("h4", "h4"), ("h5", "h5")]


def test_shapes(spark):
    f = "struct<modifiers string, result string, generics string, parameters array<struct<type string, optional boolean, rest boolean>>>"
    o = "struct<modifiers string, heritage string, generics string, members map<string, struct<signature string, optional boolean>>>"
    fun = lambda *p: ("", "int", "", list(p))
    a, opt, rest, need = ("a", False, False), ("b", True, False), ("b", True, True), ("b", False, False)
    cases = [(fun(a), fun(a, opt), True), (fun(a), fun(a, need), False), (fun(a), fun(a, rest), False), (fun(a, opt), fun(a), False), (fun(), fun(opt), True), (fun(), fun(), True), (fun(a), ("", "x", "", [a]), False)]
    df = spark.createDataFrame(cases, f"old {f}, new {f}, want boolean")
    assert all(r[0] == r[1] for r in df.select("want", edgerules.compatible_functions(F.col("old"), F.col("new"))).collect())
    obj = lambda **m: ("", "", "", m)
    cases = [(obj(a=("x", False)), obj(a=("x", False), b=("y", True)), True), (obj(a=("x", False)), obj(a=("x", False), b=("y", False)), False), (obj(a=("x", False)), obj(b=("x", True)), False), (obj(), obj(), True)]
    df = spark.createDataFrame(cases, f"old {o}, new {o}, want boolean")
    assert all(r[0] == r[1] for r in df.select("want", edgerules.compatible_objects(F.col("old"), F.col("new"))).collect())


UNITS = "cs_id int, unit_id string, old_path string, new_path string, path string, change_kind string, is_test boolean"


def test_file_and_test_rules(spark):
    u = spark.createDataFrame(
        [(1, "r", "o.ts", "n.ts", "n.ts", "rename", False), (1, "add", None, "a.ts", "a.ts", "add", False), (1, "del", "d.ts", None, "d.ts", "delete", False), (1, "c", "c.ts", "c.ts", "c.ts", "modify", False), (1, "t", None, "t.ts", "t.ts", "add", True)], UNITS
    )
    refs = spark.createDataFrame([(1, "c", "o.ts#f", "old"), (1, "t", "a.ts#g", "new")], "cs_id int, unit_id string, symbol string, side string")
    mods = spark.createDataFrame([(1, "c", "a.ts", "new"), (1, "c", "d.ts", "old"), (1, "t", "n.ts", "new")], "cs_id int, unit_id string, path string, side string")
    assert edges(edgerules.file_rules(u, refs, mods)) == {
        ("r", "c", "must_with", 100, "rename-reference"), ("r", "t", "must_with", 100, "rename-reference"), ("add", "c", "before", 90, "new-module-import"), ("c", "del", "before", 90, "removed-module-import"),
    }
    decl = spark.createDataFrame([(1, "add", "a.ts#g", "new")], "cs_id int, unit_id string, symbol string, side string")
    pairs = edgerules.reference_pairs(u, refs, mods)
    assert edges(edgerules.test_rules(u, decl, refs, pairs)) == {("add", "t", "must_with", 100, "exclusive-new-symbol-test"), ("r", "t", "affinity", 90, "implementation-test")}


def test_bindings_outputs_and_manifests(spark):
    b = spark.createDataFrame([(1, "p", "f", "x", "x", "m", "new"), (1, "p", "f", "y", "y", "m2", "new"), (1, "p", "f", "y", "y", "m", "old"), (1, "p", "f", "z", "z", "m", "old")], "cs_id int, unit_id string, path string, local string, imported string, module string, side string")
    n = spark.createDataFrame([(1, "c", "f", x, s) for x in "xyz" for s in ("old", "new")], "cs_id int, unit_id string, path string, name string, side string")
    assert edges(edgerules.binding_rules(b, n)) == {("p", "c", "before", 95, "import-binding-change"), ("p", "c", "must_with", 95, "import-binding-change"), ("c", "p", "before", 95, "removed-import-binding")}
    u = spark.createDataFrame([(1, p, p) for p in ("api.proto", "gen/a.ts", "gen/b.ts", "pkg/package.json", "package-lock.json", "other/yarn.lock")], "cs_id int, unit_id string, path string")
    assert edges(edgerules.generated_rules(u, [("*.proto", ["gen/**"])])) == {("api.proto", g, "must_with", 100, "generated-from") for g in ("gen/a.ts", "gen/b.ts")}
    deps = spark.createDataFrame([(1, "pkg/package.json", "pkg", "@s/lib", "new"), (1, "pkg/package.json", "pkg", "gone", "old")], "cs_id int, unit_id string, folder string, name string, side string")
    imps = spark.createDataFrame([(1, "c", "pkg/c.ts", "@s/lib/sub", "new"), (1, "d", "pkg2/c.ts", "@s/lib", "new"), (1, "c", "pkg/c.ts", "gone", "old")], "cs_id int, unit_id string, path string, module string, side string")
    assert edges(edgerules.manifest_rules(u, deps, imps)) == {
        ("pkg/package.json", "package-lock.json", "must_with", 100, "manifest-lockfile"), ("pkg/package.json", "c", "before", 95, "new-package-dependency"), ("c", "pkg/package.json", "before", 95, "removed-package-dependency"),
    }
    imported = spark.createDataFrame([(1, "c", "new", ["a", "a.ts", "a/index.ts"]), (1, "d", "new", ["q"])], "cs_id int, unit_id string, side string, candidates array<string>")
    tree = spark.createDataFrame([(1, "a/index.ts"), (1, "a.ts")], "cs_id int, path string")
    assert rows(edgerules.resolved_modules(imported, tree)) == [(1, "c", "new", "a.ts")]
    over = spark.createDataFrame([(1, "u", "s", "new", 9, "b"), (1, "u", "s", "new", 2, "a")], "cs_id int, unit_id string, symbol string, side string, line int, signature string")
    assert rows(edgerules.merged_overloads(over)) == [(1, "u", "s", "new", "a\nb")]


def test_place_rules_in_small_and_large_change_sets(spark):
    """All pairs up to the limit; beyond it pairs of a file, of neighbours and of those related otherwise. Of one pair's places the first counts."""
    rows = [(1, "a", "f", "x", "p"), (1, "b", "f", "x", "p"), (1, "c", "g", "x", "q"), (1, "d", "h", None, "p"), (1, "e", "i", "x", None)]
    df = spark.createDataFrame(rows, "cs_id int, unit_id string, file string, area string, package string")
    got = {(r.src, r.dst, r.weight, r.evidence) for r in edgerules.place_rules(df).collect()}
    area = lambda *pairs: {(a, b, 30, "configured-area") for a, b in pairs}
    package = lambda *pairs: {(a, b, 5, "same-package") for a, b in pairs}
    assert got == {("a", "b", 20, "same-module")} | area("ac", "ae", "bc", "be", "ce") | package("ad", "bd")
    got = {(r.src, r.dst, r.weight, r.evidence) for r in edgerules.place_rules(df, dense_units=2).collect()}
    assert got == {("a", "b", 20, "same-module")} | area("bc", "ce") | package("bd")
    also = spark.createDataFrame([(1, "e", "a"), (1, "d", "e")], "cs_id int, p string, c string")
    assert {(r.src, r.dst) for r in edgerules.place_rules(df, 2, also).collect()} == {(r[0], r[1]) for r in got} | {("a", "e")}


def test_contents_that_are_text(spark):
    df = spark.createDataFrame([(bytearray(b"a\xc3\xa9"),), (bytearray(b"a\0"),), (bytearray(b"\xff"),), (bytearray(b"long text"),), (bytearray(b""),)], "c binary")
    assert [r[0] for r in df.select(hunks.text_kind(F.col("c"), 5)).collect()] == ["text", "binary", "binary", "binary", "text"]


def test_formats(spark):
    df = spark.createDataFrame([("json", "j"), ("markdown", "m")], "k string, t string")
    assert rows(df.select(reports.formatted(F.col("k"), json=F.col("t"), markdown=F.upper("t")))) == [("M",), ("j",)]
    with pytest.raises(Exception, match="unknown format: xml"):
        df.select(reports.formatted(F.lit("xml"), json=F.col("t"))).collect()
    assert rows(df.limit(1).select(*[reports.shown_number(F.lit(x)) for x in (100.0, 66.67, 0.0, 0.5)])) == [("100", "66.67", "0", "0.5")]


def test_report_texts(spark):
    assert reports.plain_text("a\n\x1b‮\x7f") == "a\\n\\u001b\\u202e\\u007f"
    assert [reports.markdown_text(t) for t in ("# a #", "  x", "1. a", "- a", "1- a", "a_b & <c>", "")] == ["\\# a \\#", "&#32;&#32;x", "1\\. a", "\\- a", "1- a", "a\\_b &amp; \\<c\\>", ""]
    assert [reports.markdown_code(t) for t in ("a", "`a", "a``b", " a ", "  ")] == ["`a`", "`` `a ``", "```a``b```", "`  a  `", "`  `"]
    df = spark.createDataFrame(pd.DataFrame({"t": ["a*b", None]}), "t string")
    assert rows(df.select(reports.escaped(F.col("t")))) == [("a\\*b",), (None,)]


def test_markdown_report(spark):
    plan = "cs_id int, status string, base_oid string, head_oid string, tree_oid string, mode string, n_files int, n_units int, n_edges int, verified string, level string, covered int, total int, commands int, commands_run boolean, reviewability double, cohesion double, integrity double, confidence string"
    rows = [(1, "single-change", "b0", "h0", "t0", "deep", 2, 2, 1, "not-run", "reconstructed", 0, 1, 0, False, 66.67, 100.0, 100.0, "medium"), (2, "odd_one", "b`", "h", "t", "deep", 0, 0, 0, "failed", "syntax", 0, 1, 2, False, 5.0, 0.5, 0.0, "low")]
    plans = spark.createDataFrame(rows, plan)
    groups = spark.createDataFrame([(1, 1, "slice_1", "Aggiungi a*b", 3, 0, ["c.ts", "t_s.ts"], None, ["why"]), (2, 1, "g", None, 1, 1, None, ["x", "y"], None)], "cs_id int, grp int, group_id string, title string, added int, deleted int, files array<string>, depends_on array<string>, reasons array<string>")
    results = spark.createDataFrame([(2, 1, i, "g", name, status, text) for i, (name, status, text) in enumerate([("reconstruction", "passed", None), ("dependencies", "passed", ""), ("syntax", "failed", "a|b"), ("semantic", "skipped", None)])], "cs_id int, grp int, pos int, group_id string, name string, status string, message string")
    others = spark.createDataFrame([(1, 2, "c2", 2, 25.5), (1, 1, "c1", 1, 16.75)], "cs_id int, rank int, candidate_id string, n_groups int, cost double")
    warnings = spark.createDataFrame([(2, 1, "second"), (2, 0, "- first")], "cs_id int, pos int, message string")
    got = {r["cs_id"]: r["report"].split("\n") for r in reports.markdown_report(plans, groups, results, others, warnings).collect()}
    one, two = got[1], got[2]
    assert one[:8] == ["# Plan", "", "**Modifica singola**", "", "Base: `b0`  ", "Head: `h0`", "", "## Fatti osservati"]
    at = one.index("### 1. Aggiungi a\\*b")
    assert one[at + 1 : at + 11] == ["", "ID: `slice_1` · 2 file · +3/−0", "", "Dipendenze: nessuna", "", "- c.ts", "- t\\_s.ts", "", "- why", ""]
    assert reports.WORDS["no_checks"] in one and "- `c1`: 1 gruppi, costo 16.75." == one[one.index(reports.WORDS["others"]) + 2]
    assert not any(x.startswith("- Prefissi") for x in one) and one[-2:] == [reports.WORDS["no_proof"], ""]
    assert "**odd\\_one**" in two and "Base: `` b` ``  " in two and "Dipendenze: `x`, `y`" in two and not any(x.startswith("### ") for x in two)
    assert "| g | syntax | failed | a\\|b |" in two and "| Coesione strutturale | 0.5/100 |" in two
    assert two[two.index("## Limiti e incertezze") + 2 :][:2] == ["- \\- first", "- second"]
    summary = [x for x in two if x.startswith(("- Prefissi", "- Controlli", "- Esiti", "- La semantica"))]
    assert summary == ["- Prefissi con tutti i controlli richiesti superati: 0/1", "- Controlli di progetto: 2 configurati (comandi non eseguiti)", "- Esiti dei controlli (tutti i prefissi): passed 2 · failed 1 · skipped 1 · timeout 0 · unavailable 0", "- " + reports.WORDS["optional"]]
    empty = [x.where("cs_id < 0") for x in (plans, groups, results, others, warnings)]
    assert reports.markdown_report(*empty).count() == 0 and reports.markdown_report(plans, *empty[1:]).where("report IS NULL").count() == 0


def test_rebuilt_and_selection_of_nothing(spark):
    hunk = "array<struct<old_start:bigint,old_count:bigint,new_start:bigint,new_count:bigint,lines:array<string>>>"
    rows = [(1, "a\n", [(0, 0, 1, 1, ["+x"])], 1, "0"), (2, "a\n", [(0, 0, 1, 1, ["+x"])], 2, "0"), (3, None, [], 0, "0"), (4, "", [], 0, "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391")]
    got = {r["id"]: (r["oid"], r["fault"]) for r in trees.rebuilt(spark.createDataFrame(rows, f"id int, base string, hunks {hunk}, n_hunks int, new_oid string")).collect()}
    assert got[1][0] == got[2][0] and got[1][1] == "all hunks don't give the new content" and got[2][1] is None
    assert got[3] == (None, None) and got[4] == ("e69de29bb2d1d6434b8b29ae775ad8c2e48c5391", None)
    empty = lambda ddl: spark.createDataFrame([], ddl)
    files, hunks_ = empty("cs_id int, file_id string, is_atomic boolean, new_path string, new_oid string, new_mode string"), empty("cs_id int, file_id string, hunk_id string")
    found = trees.selection_faults(files, hunks_, empty("cs_id int, unit_id string, file_id string"), empty("cs_id int, unit_id string, hunk_id string"), spark.createDataFrame([(1, "u"), (1, None)], "cs_id int, unit_id string"))
    assert sorted((r["rule"], r["item"] or "") for r in found.collect()) == [("unit-unknown", ""), ("unit-unknown", "u")]


def test_edges_and_their_groups_stay_where_their_change_set_is(spark):
    """Pairs by brute force in small and large change-sets, with nulls and repeated places; no row is dealt out again for edges, their groups and their sums."""
    import random
    from itertools import combinations

    from weft.operators import groups
    from weft.session import bucketed, ship_package
    from weft.sources import adapters

    ship_package(spark)
    rng, rows = random.Random(5), []
    for cs, n in ((1, 1), (2, 40), (3, 200), (4, 230)):
        rows += [(cs, f"{rng.randrange(60):012d}:{i}", rng.randrange(40), rng.choice([None, *range(9)]), rng.choice([None, *"abcdefg"]), i) for i in range(n)]
    u = bucketed(spark.createDataFrame(rows, "cs_id bigint, unit_id string, file bigint, package bigint, area string, pos bigint"), "units", "cs_id")
    m = u.select("cs_id", "unit_id", (F.col("pos") % 5).alias("grp"))
    want = set()
    for cs in (1, 2, 3, 4):
        own = sorted(r for r in rows if r[0] == cs)
        beside = set()
        for place in (3, 4):
            for at in {r[place] for r in own} - {None}:
                of = sorted((r for r in own if r[place] == at), key=lambda r: (r[2], r[1]))
                beside |= {tuple(sorted((a[1], b[1]))) for a, b in zip(of, of[1:], strict=False)}
        for a, b in combinations(own, 2):
            weight = 20 if a[2] == b[2] else 30 if a[4] and a[4] == b[4] else 5 if a[3] is not None and a[3] == b[3] else None
            if weight and (len(own) <= 200 or weight == 20 or (a[1], b[1]) in beside):
                want.add((cs, a[1], b[1], "affinity", weight))
        for i, b in enumerate(own):
            want |= {(cs, a[1], b[1], "before", 95) for a in own[max(i - 1, 0) : i] if a[1][:12] == b[1][:12]}
            want |= {(cs, a[1], b[1], "must_with", 100) for a in [a for a in own[:i] if a[2] == b[2]][-1:]}
    found = adapters.edges(spark, u)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (found, groups.edge_groups(found, m), groups.violations(found, m), groups.metrics(u.selectExpr("*", "1 added", "1 deleted", "false is_test", "false is_generated"), found, m)):
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_merged_hunks_of_any_ids(spark):
    """The unit is a hunk, the least one, also where ids come behind the characters of other names; hunks that meet none stand for themselves."""
    rows = [(1, "f", "old", "é1", 1, 4), (1, "f", "old", "é2", 4, 5), (1, "f", "new", "é2", 7, 9), (1, "f", "new", "~3", 9, 9), (1, "g", "old", "é4", 1, 4), (1, "g", "new", "é4", 6, 6)]
    found = hunks.merged_hunks(spark.createDataFrame(rows, "cs_id bigint, file string, side string, hunk_id string, start bigint, end bigint"))
    assert sorted(tuple(r) for r in found.collect()) == sorted([("é1", "~3"), ("é2", "~3"), ("~3", "~3"), ("é4", "é4")])


def test_orders_are_checked_where_their_change_set_is(spark):
    """Components, arcs and places lie in buckets by change-set, so their joins deal nothing out again."""
    from weft.operators import planner
    from weft.session import ship_package

    ship_package(spark)
    rows = [(cs, f"u{i}", f"f{i % 3}", f"p{i % 2}", "a", 1, 1, False, False) for cs in (1, 2) for i in range(6)]
    u = planner.kept(spark.createDataFrame(rows, "cs_id bigint, unit_id string, file string, package string, area string, added bigint, deleted bigint, is_test boolean, is_generated boolean"), "units", dealt=False)
    e = planner.kept(spark.createDataFrame([(1, "u5", "u0", "before", 95), (2, "u1", "u2", "must_with", 100)], "cs_id bigint, src string, dst string, kind string, weight int"), "edges", dealt=False)
    members = planner.kept(planner.condensed(u, e), "members", dealt=False)
    components, before = planner.kept(planner.component_rows(u, members), "components"), planner.kept(planner.arcs(e, members), "arcs")
    faults = planner.order_faults(components, before, planner.kept(planner.placed(planner.orders(components, before)), "places"))
    assert {(r.cs_id, r.n, r.backward, r.unforced) for r in faults.collect()} == {(1, 6, 0, 0), (2, 5, 0, 0)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in faults.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_equal_ranges_take_one_node(spark):
    """Ranges that many hunks share are joined once; hunks with several ranges, without a last line or in no node are as before."""
    from weft.operators import hunks

    h = [(1, "f", f"h{i}", 5, 6) for i in range(300)] + [(1, "f", "two", 5, 6), (1, "f", "two", 20, 20), (1, "f", "open", 20, None), (1, "f", "out", 90, 91), (1, "g", "h0", 5, 6), (2, "f", "none", None, 3)]
    n = [(1, "f", f"n{i:03}", 0, 30, i % 3) for i in range(300)] + [(1, "f", "small", 19, 21, 0), (1, "f", "after", 19, 21, None), (1, "g", "whole", 0, 9, 0)]
    h = spark.createDataFrame(h, "cs_id int, file string, hunk_id string, first int, last int")
    found = hunks.smallest_containing(h, spark.createDataFrame(n, "cs_id int, file string, node_id string, start int, end int, depth int"))
    assert {(r.file, r.hunk_id): r.node_id for r in found.collect()} == {("f", f"h{i}"): "n002" for i in range(300)} | {("f", "two"): "small", ("f", "open"): "small", ("g", "h0"): "whole"}
    joins = [t for t in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in t and "reach" in t]
    assert joins, "ranges are joined once"


def test_selection_faults_reads_its_inputs_once(spark):
    """Behind the tables that are written once, the rules deal out nothing but the files."""
    from weft.operators import trees
    from weft.session import ship_package

    ship_package(spark)
    rows = lambda values, names: spark.createDataFrame([(1, *v) for v in values], "cs_id int, " + names)
    files = rows([("f", True, "p", "0" * 40, "100644"), ("g", False, "q", "x", "100644"), ("e", False, None, None, None)], "file_id string, is_atomic boolean, new_path string, new_oid string, new_mode string")
    hunks = rows([("f", "a"), ("f", "b"), ("g", "c")], "file_id string, hunk_id string")
    units = rows([("u", "f"), ("v", "g"), ("w", "gone"), ("x", "e"), ("y", "g")], "unit_id string, file_id string")
    held = rows([("u", "a"), ("v", "c"), ("v", "z"), ("y", "c")], "unit_id string, hunk_id string")
    chosen = rows([("u",), ("v",), ("v",), ("w",), ("x",), ("y",), ("ghost",), ("ghost",)], "unit_id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = trees.selection_faults(files, hunks, units, held, chosen)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.rule, r.item) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = [("unit-selected-twice", "v"), ("unit-selected-twice", "ghost"), ("unit-unknown", "ghost"), ("file-unknown", "w"), ("hunk-selected-twice", "c"), ("hunk-unknown", "z"),
            ("file-without-hunks", "e"), ("atomic-file-in-part", "f"), ("entry-invalid", "g")]
    assert got == sorted(want)
    assert plan.count("Exchange hashpartitioning") <= 2, plan


def test_tables_have_more_parts_where_there_are_more_lines(spark, monkeypatch):
    """What a task holds doesn't grow with the tables; tables of one query still agree on their parts, and the next query starts anew."""
    from weft import session
    from weft.operators import groups
    from weft.sources import adapters

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows, parts in ((150_000, 4), (1000, 8), (600, 12)):
            monkeypatch.setattr(session, "PART_ROWS", rows)
            session.ship_package(spark)
            u = adapters.units(spark, "/root/testdata/sf0.001")
            found = groups.violations(adapters.kept_edges(spark, u), u.select("cs_id", "unit_id", (F.col("pos") % 5).alias("grp")))
            assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
            assert found.rdd.getNumPartitions() == parts
            assert u.count() == u.select("cs_id", "unit_id").distinct().count() > 0
        session.ship_package(spark)
        assert session.bucketed(u, "again", "cs_id").groupBy("cs_id").count().rdd.getNumPartitions() == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_manifest_rules_stay_where_their_change_set_is(spark):
    """Rows that several folders or imports give come once, and none is dealt out again for that."""
    from weft.session import bucketed, ship_package

    ship_package(spark)
    u = bucketed(spark.createDataFrame([(1, p, p) for p in ("package.json", "yarn.lock", "a/package.json", "a/yarn.lock", "a/c.ts")], "cs_id int, unit_id string, path string"), "units", "cs_id")
    two = F.explode(F.array(F.lit("x"), F.lit("x")))
    deps = u.where("unit_id LIKE '%package.json'").select("cs_id", "unit_id", F.lit("").alias("folder"), two.alias("name"), F.lit("new").alias("side"))
    imps = u.where("unit_id = 'a/c.ts'").select("cs_id", "unit_id", "path", F.explode(F.array(F.lit("x"), F.lit("x/y"))).alias("module"), F.lit("new").alias("side"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = edgerules.manifest_rules(u, deps, imps)
        plan, got = found._jdf.queryExecution().executedPlan().toString(), sorted((r.src, r.dst, r.kind) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    locks = [("a/package.json", "a/yarn.lock"), ("a/package.json", "yarn.lock"), ("package.json", "yarn.lock")]
    assert got == sorted([(a, b, "must_with") for a, b in locks] + [(a, "a/c.ts", "before") for a in ("a/package.json", "package.json")])
    assert "Exchange" not in plan, plan


def test_related_pairs_of_places_stay_where_their_change_set_is(spark):
    """Related pairs by brute force, with nulls, repeats and pairs that neighbours give already; only what names or imports is dealt out, as it comes in two tables."""
    import random
    from itertools import combinations

    from weft.session import bucketed, ship_package

    ship_package(spark)
    rng, rows = random.Random(7), []
    for cs, n in ((1, 8), (2, 9), (3, 60)):
        rows += [(cs, f"u{i:03}", rng.choice([None, *range(12)]), rng.choice([None, *"pqr"]), rng.choice([None, *"abc"])) for i in range(n)]
    u = bucketed(spark.createDataFrame(rows, "cs_id bigint, unit_id string, file bigint, package string, area string"), "units", "cs_id")
    paths = u.select("cs_id", "unit_id", F.when(F.col("file") % 3 != 0, F.col("file").cast("string")).alias("old_path"), F.when(F.col("file") % 3 != 1, (F.col("file") % 7).cast("string")).alias("new_path"))
    refs = u.select("cs_id", "unit_id", F.concat((F.crc32("unit_id") % 12).cast("string"), F.lit("#f")).alias("symbol"), F.lit("new").alias("side"))
    mods = u.select("cs_id", "unit_id", (F.crc32("unit_id") % 9).cast("string").alias("path"), F.when(F.crc32("unit_id") % 2 == 0, "new").otherwise("old").alias("side"))
    named, imported = ({(r.cs_id, r.unit_id): (r[2], r.side) for r in x.collect()} for x in (refs, mods))
    own = {(r.cs_id, r.unit_id): (r.old_path, r.new_path) for r in paths.collect()}
    pairs = set()
    for p, (old, new) in own.items():
        for c in own:
            if p != c and p[0] == c[0]:
                path, side = imported[c]
                if named[c][0].split("#")[0] in (old, new) or path == (old if side == "old" else new if new is not None else old):
                    pairs.add((p[0], p[1], c[1]))
    also = edgerules.reference_pairs(paths, refs, mods)
    assert sorted(tuple(r) for r in also.collect()) == sorted(pairs)
    want = set()
    for cs in (1, 2, 3):
        of = sorted(r for r in rows if r[0] == cs)
        beside = set()
        for place in (3, 4):
            for at in {r[place] for r in of} - {None}:
                line = sorted((r for r in of if r[place] == at), key=lambda r: (r[2] is not None, r[2] or 0, r[1]))
                beside |= {tuple(sorted((a[1], b[1]))) for a, b in zip(line, line[1:], strict=False)}
        for a, b in combinations(of, 2):
            weight = 20 if a[2] is not None and a[2] == b[2] else 30 if a[4] and a[4] == b[4] else 5 if a[3] and a[3] == b[3] else None
            if weight and (len(of) <= 8 or weight == 20 or (a[1], b[1]) in beside or {(cs, a[1], b[1]), (cs, b[1], a[1])} & pairs):
                want.add((cs, a[1], b[1], weight))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = edgerules.place_rules(u, 8, also)
        plan, got = found._jdf.queryExecution().executedPlan().toString(), [(r.cs_id, r.src, r.dst, r.weight) for r in found.collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == len(set(got)) and set(got) == want
    assert plan.count("Exchange hashpartitioning") <= 1, plan


def test_hunks_of_empty_documents(spark, tmp_path):
    """As their SQL says: an empty first line, and nothing for a null text."""
    import duckdb

    from weft.plans import queries as base, rules  # noqa: F401 (adds its queries)

    texts = ["", None, "\n", "a", "a\n", "a\r\nb"]
    docs = spark.createDataFrame([(7 * i + k, t, "en") for i, t in enumerate(texts) for k in (0, 1)] + [(None, "", "en")], "doc_id long, text string, lang string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(c.sql(base.ORACLES["applied_hunks"]).fetchall(), key=str)
    assert rows(base.QUERIES["applied_hunks"](spark, str(tmp_path))) == want and (1, "\nx", None) in want


def test_all_pairs_of_large_change_sets(spark, tmp_path):
    """Ids, penalties and confidence of edges count every pair of a change-set of any size, as their SQL does."""
    import duckdb

    from weft.plans import contract, queries as base  # noqa: F401 (adds its queries)
    from weft.session import ship_package

    lines = [(o, i, (o * 7 + i) % 12, (o + i) % 9, 1.0 + i, "ARN"[i % 3], "FO"[o % 2]) for o in range(1, 120) for i in range(4)]
    pd.DataFrame(lines, columns=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"]).to_parquet(tmp_path / "lineitem.parquet")
    pd.DataFrame([(o, 1 if o < 112 else 2) for o in range(1, 120)], columns=["o_orderkey", "o_custkey"]).to_parquet(tmp_path / "orders.parquet")
    pd.DataFrame([(p, f"t{p % 5}") for p in range(12)], columns=["p_partkey", "p_type"]).to_parquet(tmp_path / "part.parquet")
    c = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    for name in ("edge_ids", "edge_penalties", "plan_confidence"):
        ship_package(spark)
        found = base.QUERIES[name](spark, str(tmp_path))
        want = c.sql(base.ORACLES[name])
        assert rows(found.select(*want.columns)) == sorted(want.fetchall(), key=str), name
    n = c.sql(f"WITH {base.WHOLE} SELECT count(*) FILTER (WHERE kind = 'affinity' AND cs_id = 1) FROM edges").fetchall()[0][0]
    assert n > 5 * c.sql(f"WITH {base.E} SELECT count(*) FILTER (WHERE kind = 'affinity' AND cs_id = 1) FROM edges").fetchall()[0][0] / 4
