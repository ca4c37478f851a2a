"""Verification with repair, against a plain loop over each plan."""

import random

import pytest
from pyspark.sql import functions as F

from weft.functions.identity import make_id
from weft.operators import repairs

SCHEMA = "cs_id int, grp int, group_id string, title string, unit_ids array<string>, depends_on array<string>, files array<string>, added long, deleted long, reasons array<string>"
TEXTS = "array<string>"


def needs_all(total):
    """Prefixes fail until they hold ``total`` units."""

    def check(live):
        so_far = live.alias("a").join(live.alias("b"), F.expr("a.cs_id = b.cs_id AND b.grp <= a.grp")).groupBy("a.cs_id", "a.grp").agg(F.sum(F.size("b.unit_ids")).alias("n"))
        return so_far.where(F.col("n") < total).select("cs_id", "grp")

    return check


def test_titles_stay_bounded_and_reasons_keep_them(spark):
    titles = [x * 750 for x in "ABC"]
    rows = [(1, i + 1, f"explicit-{i}", t, [f"u{i}"], [], [f"{'abc'[i]}.js"], 1, 0, []) for i, t in enumerate(titles)]
    units = spark.createDataFrame([(1, f"u{i}", f"{'abc'[i]}.js", None, None, False, "add") for i in range(3)], "cs_id int, unit_id string, file string, area string, package string, is_test boolean, change_kind string")
    [one] = repairs.repaired(spark.createDataFrame(rows, SCHEMA), needs_all(3), units).collect()
    assert (one.grp, one.unit_ids, one.files, one.repairs, one.over_limit) == (1, ["u0", "u1", "u2"], ["a.js", "b.js", "c.js"], 2, False)
    assert len(one.title) <= 1000 and all(t in "".join(one.reasons) for t in titles)
    assert one.group_id == make_id("slice", ["u0", "u1", "u2"])
    assert repairs.repaired(spark.createDataFrame([], SCHEMA), needs_all(3)).collect() == []


def loop(plan, fails, lines, files):
    """What the repair does to one plan, group by group."""
    plan, n, over = [dict(g) for g in plan], 0, set()
    while True:
        bad = next((i for i in range(len(plan) - 1) if fails(plan, i)), None)
        if bad is None:
            return plan, n, over
        a, b = plan[bad : bad + 2]
        new = {k: a[k] + b[k] for k in ("units", "added", "deleted")}
        new |= {"files": sorted({*a["files"], *b["files"]}), "title": f"{a['title']} + {b['title']}", "id": make_id("slice", a["units"] + b["units"])}
        new["needs"] = [d for d in dict.fromkeys(a["needs"] + b["needs"]) if d not in (a["id"], b["id"])]
        plan[bad : bad + 2] = [new]
        for g in plan:
            g["needs"] = [d for d in dict.fromkeys(new["id"] if d in (a["id"], b["id"]) else d for d in g["needs"]) if d != g["id"]]
        over -= {a["id"], b["id"]} if not over & {a["id"], b["id"]} else set()
        if over & {a["id"], b["id"]} or len(new["files"]) > files or new["added"] + new["deleted"] > lines:
            over = over - {a["id"], b["id"]} | {new["id"]}
        n += 1


@pytest.mark.parametrize("seed", range(2))
def test_against_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    plans, rows = {}, []
    for cs in range(25):
        plan = []
        for i in range(rng.randint(1, 7)):
            needs = [f"g{cs}-{j}" for j in range(i) if rng.random() < 0.4]
            plan.append({"id": f"g{cs}-{i}", "title": f"T{i}", "units": [f"u{cs}-{i}-{k}" for k in range(rng.randint(1, 3))], "needs": needs, "files": sorted({f"f{rng.randint(0, 4)}" for _ in range(2)}), "added": rng.randint(0, 40), "deleted": rng.randint(0, 9)})
            g = plan[-1]
            rows.append((cs, i + 1, g["id"], g["title"], g["units"], g["needs"], g["files"], g["added"], g["deleted"], []))
        plans[cs] = plan
    fails = lambda plan, i: (sum(g["added"] for g in plan[: i + 1]) + len(plan)) % 3 == 0

    def check(live):
        sums = live.alias("a").join(live.alias("b"), "cs_id").groupBy("cs_id", "a.grp").agg(F.sum(F.when(F.expr("b.grp <= a.grp"), F.col("b.added")).otherwise(0)).alias("s"), F.count(F.lit(1)).alias("n"))
        return sums.where("(s + n) % 3 = 0").select("cs_id", "grp")

    got = {}
    for r in repairs.repaired(spark.createDataFrame(rows, SCHEMA), check, hard_lines=60, hard_files=3).collect():
        got.setdefault(r.cs_id, []).append(r)
    for cs, plan in plans.items():
        want, n, over = loop(plan, fails, 60, 3)
        own = sorted(got[cs], key=lambda r: r.grp)
        assert [(r.group_id, r.title, r.unit_ids, r.depends_on, r.files, r.added, r.deleted, r.over_limit) for r in own] == [(g["id"], g["title"], g["units"], g["needs"], g["files"], g["added"], g["deleted"], g["id"] in over) for g in want], cs
        assert {r.repairs for r in own} == {n}
