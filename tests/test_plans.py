import hashlib
import json

import pytest
from pyspark.sql import functions as F

from weft.functions import identity, paths
from weft.operators import facts, groups, planner, snapshots, validation, verification
from weft.sources import config, plans


def test_settings():
    s = config.settings('{ // a comment\n "limits": {"maxGroups": 3,}, "areas": [{"name": "a//b", "patterns": ["src/**/*.ts"]}], /* more */ }')
    assert s.planner() == planner.Limits(350, 12, 800, 30, 3)
    assert s.areas == (("a//b", ["src/**/*.ts"]),) and s.keep_tests
    assert config.settings().planner() == planner.DEFAULT
    for bad in (
        '{"limit": {}}', '{"limits": {"maxGroups": 21}}', '{"limits": {"maxGroups": true}}', '{"limits": {"targetFiles": 31}}', '{"areas": [{"name": "a"}]}', '{"schemaVersion": 2}',
        '{"environment": {"allow": ["1X"]}}', '{"checks": [{"name": "a", "command": "c", "args": [], "timeoutMs": 1}, {"name": "a", "command": "c", "args": [], "timeoutMs": 1}]}', "[]", '{"base": ""}',
    ):
        with pytest.raises(ValueError):
            config.settings(bad)


def test_normalized_paths(spark):
    cases = {"a/./b//c": "a/b/c", "a/../b": "b", "a/../../b": "../b", "../../a": "../../a", ".": ".", "": ".", "a/b/../..": ".", "a/": "a/", "./": "./"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.n for r in df.select("p", paths.normalized(F.col("p")).alias("n")).collect()} == cases
    got = df.limit(1).select(paths.import_targets(F.lit("src/a.ts"), F.lit("./b.js")), paths.import_targets(F.lit("a.ts"), F.lit("../b")), paths.import_targets(F.lit("a.ts"), F.lit("react"))).first()
    assert got[0][:3] == ["src/b.js", "src/b.ts", "src/b.tsx"] and len(got[0]) == 13 and "src/b/index.ts" in got[0]
    assert got[1] == [] and got[2] == []


TREE = "cs_id int, path string, mode string, type string, content string"


def _tree(spark, files):
    return spark.createDataFrame([(1, p, "100644", "blob", c) for p, c in files.items()], TREE)


def test_fast_selection(spark):
    tree = _tree(spark, dict.fromkeys(["package.json", "src/package.json", "lib/package.json", "src/a.ts", "src/b/index.ts", "src/c.ts", "d.md"], ""))
    changes = spark.createDataFrame([(1, "src/a.ts", "src/a.ts"), (1, "gone.ts", None)], "cs_id int, old_path string, new_path string")
    imports = spark.createDataFrame([(1, "src/a.ts", "./b"), (1, "src/c.ts", "../d.md")], "cs_id int, path string, module string")
    got = {r.path for r in snapshots.fast_selection(tree, changes, imports).collect()}
    assert got == {"package.json", "src/package.json", "src/a.ts", "src/b/index.ts"}
    assert snapshots.fast_selection(tree.limit(0), changes, imports).count() == 0


def test_analysis_selection(spark):
    tree = _tree(spark, {
        "tsconfig.json": '{"extends": ["./conf/base", "shared"], "references": [{"path": "./pkg"}] /* c */}', "conf/base": '{"extends": "./deep"}', "conf/deep": '{"extends": "./base"}',
        "conf/other": "{}", "node_modules/shared/package.json": '{"tsconfig": "conf.in"}', "node_modules/shared/conf.in": "{}", "pkg/tsconfig.json": "not json", "a.md": "", "x.mts": None,
    })
    got = {r.path for r in snapshots.analysis_selection(tree).collect()}
    assert got == {"tsconfig.json", "conf/base", "conf/deep", "node_modules/shared/package.json", "node_modules/shared/conf.in", "pkg/tsconfig.json", "x.mts"}


SOURCE = """import def, { a as b, type T, c } from './m'; // import x from 'no'
import * as ns from "n"
/* function gone() {
} */
export async function first(x = "}") {
  const inner = () => { return '{'; };
}
const url = 'http://x/**';
class Second {
  m() { return `a ${1} b`; }
}
export { z } from './z'; const lazy = import('./lazy');
type U = { a: 1 }
"""


def test_facts(spark):
    files = spark.createDataFrame([(1, "s.ts", SOURCE), (1, "e.ts", ""), (1, "n.ts", None)], "cs_id int, path string, content string")
    assert {r.module for r in facts.modules(files).collect()} == {"./m", "n", "./z", "./lazy"}
    assert {(r.local, r.imported, r.module) for r in facts.bindings(files).collect()} == {("def", "default", "./m"), ("b", "a", "./m"), ("T", "T", "./m"), ("c", "c", "./m"), ("ns", "*", "n")}
    got = {(r.name, r.kind, r.start_line, r.end_line) for r in facts.declarations(files).collect()}
    assert got == {("first", "function", 5, 7), ("url", "const", 8, 8), ("Second", "class", 9, 11), ("U", "type", 13, 13)}


def test_verification(spark):
    ok = [("reconstruction", "passed"), ("syntax", "passed"), ("semantic", "skipped"), ("build", "passed")]
    cases = {
        1: ([ok, ok], ("passed", "project", "split-verified", 2, 2)),
        2: ([ok, [("reconstruction", "passed"), ("snapshot", "unavailable")]], ("verification-unavailable", "reconstructed", "split-unverified", 1, 2)),
        3: ([[("reconstruction", "passed"), ("dependencies", "unavailable"), *ok[1:]]], ("verification-unavailable", "syntax", "single-change", 0, 1)),
        4: ([ok, [*ok[:3], ("build", "timeout")]], ("failed", "syntax", "split-unverified", 1, 2)),
        5: ([ok[:2] + [("semantic", "passed")]], ("passed", "semantic", "single-change", 1, 1)),
    }
    rows = [(cs, g + 1, i, name, status) for cs, (gs, _) in cases.items() for g, checks in enumerate(gs) for i, (name, status) in enumerate(checks)]
    results = spark.createDataFrame(rows, "cs_id int, grp int, pos int, name string, status string")
    got = {r.cs_id: tuple(r)[1:6] for r in verification.verification(results, results).select("cs_id", "status", "level", "plan_status", "covered", "total").collect()}
    assert got == {cs: want for cs, (_, want) in cases.items()}
    assert verification.verification(results.limit(0), results.limit(0)).count() == 0


def test_diagnostics(spark):
    d = spark.createDataFrame([(1, 1, "semantic", 2307, "Cannot find module 'react'"), (1, 2, "semantic", 2307, "Cannot find module './x'"), (1, 3, "syntax", 1005, None)], "cs_id int, grp int, phase string, code int, message string")
    p = spark.createDataFrame([(1, g, g != 5, True) for g in range(1, 6)], "cs_id int, grp int, configured boolean, complete boolean")
    got = {r.grp: (r.syntax, r.semantic) for r in verification.diagnosed(d, p).collect()}
    assert got == {1: ("passed", "unavailable"), 2: ("passed", "failed"), 3: ("failed", "failed"), 4: ("passed", "passed"), 5: ("passed", "unavailable")}


def test_confidence(spark):
    def of(edges, units=4):
        m = spark.createDataFrame([(1, f"u{i}", 1 + i // 2) for i in range(units)], "cs_id int, unit_id string, grp bigint")
        e = spark.createDataFrame([(1, *x) for x in edges], "cs_id int, src string, dst string, kind string, weight int, evidence string")
        return groups.confidence(e, m).first()["confidence"]

    two = [("u0", "u2", "before", 95, "new-module-import"), ("u1", "u3", "before", 95, "new-symbol-reference")]
    assert of(two) == "high"
    assert of([two[0], two[0]]) == of([two[0], ("u1", "u3", "before", 89, "new-module-import")]) == of([two[0], ("u1", "u3", "before", 95, "same-module")]) == "medium"
    assert of([]) == of([*two, ("u0", "u1", "unknown", 1, "x")]) == "low"


def test_titles(spark):
    rows = [(1, "a", "src/x.ts", None, None, "add", False), (1, "b", "src/y.ts", None, "p", "add", False), (2, "c", "t/z.test.ts", "core", "p", "modify", True), (3, "d", "q/w.ts", None, None, "delete", False)]
    u = spark.createDataFrame(rows, "cs_id int, unit_id string, file string, area string, package string, change_kind string, is_test boolean")
    got = {r.cs_id: r.title for r in groups.titles(u, u.select("cs_id", "unit_id", F.lit(1).alias("grp"))).collect()}
    assert got == {1: "Aggiungi p (2 file)", 2: "Aggiorna i test di core", 3: "Rimuovi w.ts"}


def test_plan_files(spark, tmp_path):
    plan = {
        "schemaVersion": 1, "toolVersion": "1", "repository": {"b": 1, "a": None}, "config": {}, "analysisMode": "deep", "files": [], "status": "single-change",
        "units": [{"id": "u", "newPath": "é\u001b.ts", "oldPath": None, "addedLines": 2, "deletedLines": 1, "isTest": False, "isGenerated": False, "changeKind": "add"}],
        "edges": [], "groups": [{"id": "g", "unitIds": ["u"], "dependsOn": [], "title": "not covered"}], "candidates": [],
    }
    covered = {k: v for k, v in plan.items() if k not in ("status", "candidates")} | {"groups": [{"id": "g", "unitIds": ["u"], "dependsOn": []}]}
    real = hashlib.sha256(json.dumps(covered, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    (tmp_path / "good.json").write_text(json.dumps(plan | {"integrity": {"digest": real}}))
    (tmp_path / "old.json").write_text(json.dumps(plan | {"integrity": {"digest": "x"}}, indent=1))
    (tmp_path / "bad.json").write_text("[1")
    got = plans.read_plans(spark, str(tmp_path)).withColumn("cs_id", F.regexp_extract("cs_id", r"(\w+)\.json$", 1))
    assert {r.cs_id for r in got.where("plan IS NULL").collect()} == {"bad"}
    assert [tuple(r) for r in plans.stale(got.where("plan IS NOT NULL")).collect()] == [("old", "x", real)]
    tables = plans.plan_tables(got)
    assert {(r.cs_id, r.unit_id, r.file, r.added) for r in tables["units"].collect()} == {("good", "u", "é\x1b.ts", 2), ("old", "u", "é\x1b.ts", 2)}
    assert tables["membership"].count() == 2 and tables["edges"].count() == 0
    assert identity.plan_digest(plan) == real


def test_candidates_derived_anew(spark):
    rows = [(1, u, f"{u}.ts", "p", "x", 300, 0, False, False) for u in "abc"]
    u = spark.createDataFrame(rows, "cs_id bigint, unit_id string, file string, package string, area string, added bigint, deleted bigint, is_test boolean, is_generated boolean")
    e = spark.createDataFrame([(1, "a", "b", "before", 95.0)], "cs_id bigint, src string, dst string, kind string, weight double")
    real = planner.candidates(u, e)
    assert real.count() > 1 and validation.candidate_rules(u, e, real).count() == 0
    wrong = real.withColumn("cost", F.when(F.col("rank") == 1, F.col("cost") + 1).otherwise(F.col("cost"))).where("rank <> 2")
    assert sorted(r.rule for r in validation.candidate_rules(u, e, wrong).collect()) == ["candidate-differs", "candidate-missing"]
    assert {r.rule for r in validation.candidate_rules(u, e, real, u).collect()} == {"candidate-unfounded"}
