import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import identity, paths
from weft.operators import components, edgerules, groups, hunks, planner, schemas
from weft.operators.components import connected_components

FILE = ["a.ts", "a.ts", "18795c5e1efa801e5ffaca6873b020d84b0b1d19", "4b44f31f4e1794bd43530f9d5fca03585b4a1f8b", "100644", "100644"]


def test_ids_match_the_fixed_values():
    assert identity.make_id("f", FILE) == "f_156571b575c3b13b"
    assert identity.make_id("h", ["f_156571b575c3b13b", 0, "@@ -1 +1 @@"]) == "h_fea9578311238bec"
    assert identity.make_id("cu", {"hunks": ["h_fea9578311238bec"], "file": "f_156571b575c3b13b"}) == "cu_6cc26faa25b9d36b"
    assert identity.make_id("slice", ["cu_6cc26faa25b9d36b", "cu_a6e9cb25d697e624"]) == "slice_b578ebd8f83278af"
    assert identity.make_id("candidate", ["slice_b578ebd8f83278af"]) == "candidate_0605800ca1cb7efd"
    assert identity.canonical({"b": identity.ABSENT, "a": None, "\U0001f600": 1, "～": "\x1b"}) == '{"a":null,"\U0001f600":1,"～":"\\u001b"}'


def test_native_ids(spark):
    row = spark.range(1).select(
        identity.edge_id(F.lit("cu_6cc26faa25b9d36b"), F.lit("cu_a6e9cb25d697e624"), F.lit("must_with")), identity.blob_oid(F.lit("export const a=1;\n"))
    ).first()
    assert tuple(row) == ("edge_29a954d087504cef", "8cfc2f235869a79f41ae2d66195262729425b88c")


def test_ids_of_lists_need_no_python(spark):
    lists = [["a", "b"], [], [None, "x"], ['"', "\\", '\\"'], ["".join(map(chr, range(160)))], ["é", "\U0001f926", "\u2028"], ["a,b", '"]']]
    found = spark.createDataFrame([(x,) for x in lists], "x array<string>").select("x", identity.list_id("slice", F.col("x")).alias("id"))
    assert [r.id for r in found.collect()] == [identity.make_id("slice", x) for x in lists]
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "").replace("applySchemaToPythonRDD", "")
    one = spark.range(1).select(planner.plan_id(F.array(F.array(F.lit("cu_6cc26faa25b9d36b"), F.lit("cu_a6e9cb25d697e624"))))).first()[0]
    assert one == "candidate_0605800ca1cb7efd"


def test_cuts_stay_where_their_change_set_is(spark):
    """No row is dealt out again between the blocks of change-sets and their ranked plans."""
    from weft.session import ship_package

    ship_package(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        us, es = frames(spark, {cs: ({x: {"added": 10, "package": x} for x in "abc"}, [("a", "b", "before", 9.0), ("b", "c", "affinity", 9.0)]) for cs in range(9)})
        us, es = planner.kept(us, "units", dealt=False), planner.kept(es, "edges", dealt=False)
        members = planner.kept(us.select("cs_id", "unit_id", F.col("unit_id").alias("component")), "members")
        components = planner.kept(planner.component_rows(us, members), "components")
        places = planner.kept(planner.placed(planner.orders(components, planner.arcs(es, members))), "places")
        blocks = planner.kept(planner.block_rows(components, places), "blocks")
        seen = planner.kept(planner.seen_before(blocks), "seen")
        pairs = planner.block_pairs(us, es, members, places, seen)
        for rows in (components, pairs, planner.ranked(planner.cut_plans(blocks, seen, pairs))):
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_paths(spark):
    rows = ["a.ts", "a/b.ts", "src/a.ts", "src/a/b.ts", "../x", "a//b", "a\\b", "/a", "C:x", ".git/x", ""]
    df = spark.createDataFrame([(r,) for r in rows], "p string")
    got = {r[0]: tuple(r)[1:] for r in df.select("p", paths.matches_any(F.col("p"), ["**/*.ts"]), paths.matches_any(F.col("p"), ["src/*"]), paths.is_safe(F.col("p"))).collect()}
    assert got["a.ts"][:2] == (True, False) and got["a/b.ts"][0]
    assert got["src/a.ts"][1] and not got["src/a/b.ts"][1]
    assert [p for p in rows if got[p][2]] == rows[:4]
    assert df.where("p = 'src/a/b.ts'").select(paths.ancestors(F.col("p"))).first()[0] == ["", "src", "src/a"]


def test_hunks(spark):
    patch = "diff\n@@ -1,2 +1 @@\n-a\r\n-b\n+c\r\n@@ -5,0 +5,1 @@\n+z\n\\ No newline at end of file\n"
    rows = sorted(hunks.parse_hunks(spark.createDataFrame([("f", patch)], "file string, patch string")).collect(), key=lambda r: r.ordinal)
    assert [(r.old_start, r.old_count, r.new_start, r.new_count) for r in rows] == [(1, 2, 1, 1), (5, 0, 5, 1)]
    assert rows[0].lines == ["-a\r", "-b", "+c\r"]
    base = "a\r\nb\nx\ny\nw\n"
    h = [{k: v for k, v in r.asDict().items() if k not in ("file", "ordinal")} for r in rows]
    cases = {
        (base, 2): (h, "c\r\nx\ny\nw\nz", None), (base, 1): (h[:1], "c\r\nx\ny\nw\n", None), (base, 0): ([], base, None), ("", 0): ([], "", None), (None, 0): (h, None, None), (base, -1): (h[::-1], "c\r\nx\ny\nw\nz", None),
        ("q\nb\n", 1): (h[:1], None, "hunk doesn't match the file"), (base, 9): ([h[0], dict(h[0], old_start=2)], None, "hunk overlaps another or lies outside the file"),
        (base, 8): ([dict(h[0], old_count=1)], None, "hunk lines don't match its counts"), ("a\n", 1): (h[:1], None, "hunk overlaps another or lies outside the file"),
        ("a\nb", 5): ([{"old_start": 2, "old_count": 1, "new_start": 2, "new_count": 1, "lines": ["-b", hunks.NO_NEWLINE, "+c"]}], "a\nc\n", None),
    }
    df = spark.createDataFrame([(*k, v[0]) for k, v in cases.items()], "base string, n int, hunks array<struct<old_start long, old_count long, new_start long, new_count long, lines array<string>>>")
    for r in hunks.apply_all(df).collect():
        assert (r.head, r.fault) == cases[r.base, r.n][1:], (r.base, r.n)


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1120)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    got = dict(map(tuple, connected_components(spark.createDataFrame([*edges, (None, 3)], "src long, dst long")).collect()))
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_rounds_of_components_are_written_compressed(spark, monkeypatch):
    """Not checkpointed, which writes rows as they are in memory."""
    edges = spark.createDataFrame([(f"n{i:05}", f"n{i + 1:05}") for i in range(200)], "src string, dst string")
    monkeypatch.setattr(type(edges), "checkpoint", lambda *a, **b: pytest.fail("checkpointed"))
    assert {tuple(r) for r in connected_components(edges).collect()} == {(f"n{i:05}", "n00000") for i in range(201)}


def reachable(after, n):
    seen, todo = {n}, [n]
    while todo:
        for m in after.get(todo.pop(), ()):
            if m not in seen:
                seen.add(m)
                todo.append(m)
    return seen


def test_strong_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(80)] + [(1000 + i, 1001 + i) for i in range(9)] + [(1009, 1004), (7, 7)]
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    reach = {n: reachable(after, n) for e in edges for n in e}
    want = {n: min(m for m in r if n in reach[m]) for n, r in reach.items() if any(m != n and n in reach[m] for m in r)}
    got = dict(map(tuple, components.strong_components(spark.createDataFrame([*edges, (None, 3)], "src long, dst long")).collect()))
    assert got == want and len(set(want.values())) > 1
    assert components.strong_components(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")).count() == 0


def components_of(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    reach = {n: reachable(after, n) for e in edges for n in e}
    return {n: min(m for m in r if n in reach[m]) for n, r in reach.items() if any(m != n and n in reach[m] for m in r)}


@pytest.mark.parametrize("seed", range(4))
def test_strong_components_with_runs_rings_and_branches(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(25), rng.randrange(25)) for _ in range(rng.choice((18, 28, 45)))]
    for k in range(4):  # runs between two nodes, one node, nowhere; rings
        run = [100 * (k + 1) + i for i in range(rng.randint(1, 9))]
        ends = rng.choice([(rng.randrange(25), rng.randrange(25)), (7, 7), (None, rng.randrange(25)), (run[-1], run[0])])
        path = [ends[0], *run, ends[1]]
        edges += [(a, b) for a, b in zip(path, path[1:]) if a is not None and a != b]
    want = components_of(edges)
    got = dict(map(tuple, components.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert got == want


def test_a_very_long_path_and_a_very_long_ring_take_few_rounds(spark, monkeypatch):
    rounds = []
    kept = components._kept
    monkeypatch.setattr(components, "_kept", lambda df: rounds.append(1) or kept(df))
    n = 100_000
    path = spark.range(n).select(((F.col("id") * 7919) % n).alias("src"), (((F.col("id") + 1) * 7919) % n).alias("dst")).where(f"src <> {(n - 1) * 7919 % n}")
    assert components.strong_components(path).count() == 0 and len(rounds) < 40
    rounds.clear()
    ring = spark.range(n).select((F.col("id") + 5).alias("src"), ((F.col("id") + 1) % n + 5).alias("dst"))
    got = components.strong_components(ring.unionByName(spark.createDataFrame([(3, 9), (9, 1)], "src long, dst long")))
    assert got.groupBy("component").count().collect() == [(5, n)] and len(rounds) < 60


def test_order_kernel():
    same = dict.fromkeys("abcd", 0)
    assert planner.topological(list("abcd"), {"a": {"d"}, "b": {"d"}}, same) == list("abcd")
    assert planner.topological(list("ab"), {"b": {"a"}}, {"a": 0, "b": 1}) == ["b", "a"]
    with pytest.raises(ValueError):
        planner.topological(list("ab"), {"a": {"b"}, "b": {"a"}}, same)
    assert planner.topological(list(range(12_000)), {i: {i + 1} for i in range(11_999)}, dict.fromkeys(range(12_000), 0)) == list(range(12_000))


def test_best_cuts_are_the_least():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = int(rng.integers(1, 8))
        cost = np.where(np.triu(np.ones((n + 1, n + 1)), 1) > 0, rng.integers(0, 30, (n + 1, n + 1)).astype(float), np.inf)
        cost[rng.random((n + 1, n + 1)) < 0.1] = np.inf
        want = {}
        for k in range(1 << (n - 1)):
            ends = [i + 1 for i in range(n - 1) if k >> i & 1] + [n]
            total = sum(cost[s, e] for s, e in zip([0, *ends[:-1]], ends, strict=True))
            if np.isfinite(total):
                want[len(ends)] = min(want.get(len(ends), np.inf), total)
        got = planner.best_cuts(cost, 20)
        assert {len(ends): c for c, ends in got} == want
        assert all(sum(cost[s, e] for s, e in zip([0, *ends[:-1]], ends, strict=True)) == c for c, ends in got)


Small = planner.Limits(20, 4, 100, 20, 5)
UNIT = "cs_id long, unit_id string, file string, package string, area string, added long, deleted long, is_test boolean, is_generated boolean"
EDGE = "cs_id long, src string, dst string, kind string, weight double, requires_together boolean"


def frames(spark, cases):
    """Units and edges of several change-sets: {cs: (units {name: fields}, edges)}."""
    us, es = [], []
    for cs, (units, edges) in cases.items():
        for name, x in units.items():
            f = {"file": f"src/{name}.ts", "package": None, "area": None, "added": 20, "deleted": 0, "is_test": False, "is_generated": False} | x
            us.append((cs, name, f["file"], f["package"], f["area"], f["added"], f["deleted"], f["is_test"], f["is_generated"]))
        es += [(cs, *e, *[None] * (5 - len(e))) for e in edges]
    return spark.createDataFrame(us, UNIT), spark.createDataFrame(es, EDGE)


def plans_of(spark, cases, limits):
    out = {}
    for r in sorted(planner.candidates(*frames(spark, cases), limits).collect(), key=lambda r: (r.cs_id, r["rank"])):
        out.setdefault(r.cs_id, []).append((r.cost, r.groups, r.status))
    return out


def test_plans(spark):
    x = {"added": 10, "file": "x"}
    got = plans_of(spark, {1: ({"a": {"added": 4}, "b": {"added": 0}}, [("a", "b", "must_with", 100.0)])}, replace(Small, target_lines=2))
    assert got == {1: [(43.0, [["a", "b"]], "single-change")]}
    cases = {
        2: ({"a": x, "b": x}, [("a", "b", "before", 95.0)]), 3: ({"a": {}, "b": {}}, [("a", "b", "must_with", 100.0)]),
        4: ({"a": x, "b": x}, [("a", "b", "unknown", 10.0, True)]), 5: ({"a": x, "b": x, "c": {"added": 1}}, [("a", "b", "before", 9.0), ("b", "a", "before", 9.0)]),
    }
    got = plans_of(spark, cases, replace(Small, target_lines=10, hard_lines=15))
    assert [p[1] for p in got[2]] == [[["a"], ["b"]]] and got[2][0][2] == "split-unverified"
    for cs in (3, 4, 5):  # what can't be split passes the limit
        assert got[cs] == [(planner.NO_COST, [sorted(cases[cs][0])], "cannot-safely-split")]
    us, es = frames(spark, cases)
    rows = planner.component_rows(us, planner.condensed(us, es))
    assert sorted((r.cs_id, r.component, r.lines) for r in planner.oversized(rows, replace(Small, hard_lines=15)).collect()) == [(3, "a", 40), (4, "a", 20), (5, "a", 20)]


def test_plans_keep_what_must_hold(spark):
    cases = {}
    for seed in range(1, 25):
        rng = random.Random(seed)
        names = [f"u{i:02}" for i in range(rng.randint(5, 30))]
        units = {u: {"added": rng.randint(1, 30), "package": rng.choice(["p", "q", None]), "area": rng.choice(["x", "y", "z", None])} for u in names}
        edges = []
        for _ in names:
            a, b = sorted(rng.sample(names, 2))
            edges.append((a, b, rng.choice(("before", "before", "affinity", "affinity", "must_with", "separate")), float(rng.randint(0, 100))))
        cases[seed] = (units, edges)
    found = plans_of(spark, cases, Small)
    back = {cs: (dict(reversed(us.items())), es[::-1]) for cs, (us, es) in cases.items()}
    assert plans_of(spark, back, Small) == found and set(found) == set(cases)
    for cs, plans in found.items():
        units, edges = cases[cs]
        assert len(plans) <= 5 and len({str(p[1]) for p in plans}) == len(plans)
        assert [p[0] for p in plans] == sorted(p[0] for p in plans)
        for _, groups, status in plans:
            at = {u: i for i, g in enumerate(groups) for u in g}
            assert sorted(at) == sorted(units) and sum(map(len, groups)) == len(units)
            assert status == "cannot-safely-split" or all(sum(units[u]["added"] for u in g) <= Small.hard_lines for g in groups)
            for a, b, kind, _ in edges:
                assert kind != "must_with" or at[a] == at[b]
                assert kind != "before" or at[a] <= at[b]


def test_cuts_cost_what_their_definition_says(spark):
    rng = random.Random(8)
    rows, pairs, given = [], [], {}
    for cs in range(6):
        n = rng.randint(1, 6)
        own = [(b, rng.randint(0, 30), rng.randint(0, 30), *[rng.sample(names, rng.randint(0, 3)) for names in ("abcd", "pqr", "xyz")], [f"u{b}"]) for b in range(n)]
        ends = [(a, b, float(rng.randint(-50, 50)), float(rng.randint(0, 9))) for a in range(n) for b in range(a, n) if rng.random() < 0.5]
        rows += [(cs, 0, *r) for r in own]
        pairs += [(cs, 0, *e) for e in ends]
        given[cs] = (own, ends)
    blocks = spark.createDataFrame(rows, "cs_id long, mode int, block int, lines long, review long, files array<string>, packages array<string>, areas array<string>, units array<string>")
    seen = planner.seen_before(blocks)
    shared = spark.createDataFrame(pairs, "cs_id long, mode int, a int, b int, inside double, fixed double")
    limits = planner.Limits(20, 2, 60, 4, 20)

    last, want_seen = {}, Counter()
    for cs, (own, _) in given.items():
        for r in own:
            for kind in range(3):
                for name in r[3 + kind]:
                    want_seen[cs, kind, r[0], last.get((cs, kind, name))] += 1
                    last[cs, kind, name] = r[0]
    assert {(r.cs_id, r.kind, r.block, r.prev): r.n for r in seen.collect()} == want_seen

    def cost_of(own, ends, s, e):
        part = own[s:e]
        names = [len({x for r in part for x in r[i]}) for i in (3, 4, 5)]
        if sum(r[1] for r in part) > limits.hard_lines or names[0] > limits.hard_files:
            return np.inf
        size, spread = sum(r[2] for r in part) / 20, names[0] / 2
        fit = 8 + 35 * max(0, size - 1) ** 2 + 10 * max(0, 0.25 - size) + 12 * max(0, spread - 1) ** 2 + 18 * max(0, names[1] - 1) + 24 * max(0, names[2] - 1)
        return fit + sum(x for a, b, x, _ in ends if s <= a and b < e)

    want = {}
    for cs, (own, ends) in given.items():
        n = len(own)
        for k in range(1 << (n - 1)):
            cut = [0, *[i + 1 for i in range(n - 1) if k >> i & 1], n]
            total = sum(cost_of(own, ends, s, e) for s, e in zip(cut[:-1], cut[1:], strict=True)) + sum(x[3] for x in ends)
            if np.isfinite(total):
                want[cs, len(cut) - 1] = min(want.get((cs, len(cut) - 1), np.inf), round(total, 6))
    got = planner.cut_plans(blocks, seen, shared, limits).collect()
    assert {(r.cs_id, r.n_groups): round(r.cost, 6) for r in got} == want
    assert all(sum(r.groups, []) == [f"u{b}" for b in range(len(given[r.cs_id][0]))] for r in got)


def test_plans_of_very_many_components(spark):
    n = 805
    us, es = frames(spark, {1: ({f"u{i:04}": {"added": 0, "file": "one"} for i in range(n)}, [])})
    rows = planner.component_rows(us, planner.condensed(us, es))
    places = planner.placed(planner.orders(rows, planner.arcs(es, planner.condensed(us, es)))).collect()
    want = [b for b in range(800) for _ in range(b * n // 800, (b + 1) * n // 800)]
    assert [r.block for r in sorted(places, key=lambda r: r.pos)] == want
    assert sorted(r.unit_id for r in planner.best_membership(planner.candidates(us, es, Small)).collect()) == [f"u{i:04}" for i in range(n)]


def test_symbol_rules(spark):
    d = spark.createDataFrame([(1, "p", "new", "f()", "n"), (1, "q", "gone", "g()", "o"), (1, "r", "same", "h(a", "o"), (1, "r", "same", "h(a,b?", "n")], "cs_id int, unit_id string, symbol string, signature string, s string")
    d = d.withColumn("side", F.when(F.col("s") == "o", "old").otherwise("new")).drop("s")
    r = spark.createDataFrame([(1, "c", "new", "new"), (1, "c", "gone", "old"), (1, "c", "same", "new")], "cs_id int, unit_id string, symbol string, side string")
    got = {(x.src, x.dst, x.kind, x.weight, x.evidence) for x in edgerules.symbol_rules(d, r).collect()}
    assert got == {("p", "c", "before", 95, "new-symbol-reference"), ("c", "q", "before", 95, "removed-symbol-reference"), ("r", "c", "before", 90, "compatible-signature-change")}


def test_penalties(spark):
    row = spark.range(1).select(*[groups.penalty(F.lit(k), F.lit(w), F.lit(t)) for k, w, t in (("must_with", 100, False), ("unknown", 10, False), ("before", 95, False), ("affinity", 200, True), ("affinity", 50, False))]).first()
    assert [round(x, 6) for x in row] == [0.0, 40.0, 9.5, 80.0, 20.0]


def test_schema_faults(spark):
    rule = {
        "type": "object", "required": ["a", "b"], "additionalProperties": False, "$defs": {"n": {"type": ["number", "null"]}},
        "properties": {
            "a": {"type": "integer", "minimum": 1}, "b": {"$ref": "#/$defs/n"}, "v": {"const": 1}, "m": {"type": "object", "additionalProperties": {"enum": [1, "x", True]}},
            "t": {"type": "array", "uniqueItems": True, "maxItems": 3, "items": {"type": ["string", "null"], "minLength": 2, "pattern": "^[a-z]+$"}},
        },
    }
    cases = [
        ('{"a":1,"b":null}', set()), ('{"a":1.0,"b":2.5,"t":["ab",null],"m":{"k":1,"l":"x","m":true}}', set()), ("{}", {("a", "required"), ("b", "required")}),
        ('{"a":1,"b":1,"t":["ab","ab","ABC","a"]}', {("t", "maxItems"), ("t[1]", "uniqueItems"), ("t[2]", "pattern"), ("t[3]", "minLength")}),
        ('{"a":"1","b":"x","z z":1,"q":2}', {("a", "type"), ("b", "type"), ('["z z"]', "additionalProperties"), ("q", "additionalProperties")}),
        ('{"a":0,"b":1,"m":{"n":"1","o":null},"v":"1"}', {("a", "minimum"), ('m["n"]', "enum"), ('m["o"]', "enum"), ("v", "const")}),
        ('{"a":9007199254740993,"b":1,"t":["ab\\n"]}', {("a", "type"), ("t[0]", "pattern")}), ('{"a":null,"b":1}', {("a", "type")}),
        ("[1]", {("$", "type")}), ("null", {("$", "type")}), ('{"a":1,"a":2}', {("$", "json")}), (None, {("$", "json")}), ("", {("$", "json")}), ("nope", {("$", "json")}),
    ]
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "i int, record string")
    got = {i: set() for i in range(len(cases))}
    for r in schemas.schema_faults(rows, "record", rule).collect():
        got[r["i"]].add((r["path"], r["reason"]))
    assert got == {i: faults for i, (_, faults) in enumerate(cases)}
    with pytest.raises(ValueError):
        schemas.schema_faults(rows, "record", {"$ref": "#/$defs/x", "$defs": {"x": {"$ref": "#/$defs/x"}}})
    with pytest.raises(ValueError, match="no schema is given"):
        schemas.schema_faults(rows, "record", {"$ref": "other.json#/a"})
    with pytest.raises(ValueError, match="itself"):
        schemas.schema_faults(rows, "record", {"$ref": "a.json"}, {"a.json": {"$ref": "b.json"}, "b.json": {"$ref": "a.json#"}})


def test_schema_that_refers_to_another(spark):
    settings = {"$defs": {"name": {"type": "string", "maxLength": 3}}, "type": "object", "properties": {"areas": {"items": {"$ref": "#/$defs/name"}}}, "additionalProperties": False}
    plan = {"$defs": {"name": {"type": "integer"}}, "properties": {"config": {"$ref": "settings.json"}, "title": {"$ref": "settings.json#/$defs/name"}, "count": {"$ref": "#/$defs/name"}}}
    texts = ['{"config": {"areas": ["a", "long", 5], "x": 1}, "title": "long", "count": "a"}', '{"config": {"areas": []}, "title": "abc", "count": 1}', '{"config": 7}']
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, record string")
    got = sorted((r.id, r.path, r.reason) for r in schemas.schema_faults(rows, "record", plan, {"settings.json": settings}).collect())
    assert got == [(0, "config.areas[1]", "maxLength"), (0, "config.areas[2]", "type"), (0, "config.x", "additionalProperties"), (0, "count", "type"), (0, "title", "maxLength"), (2, "config", "type")]
