"""Constraints of a plan, each as rows (cs_id, rule, item) for what violates it; a valid plan gives none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.groups import HARD_FILES, HARD_LINES, edge_groups, group_totals, holds_together
from weft.operators.planner import DEFAULT, Limits, candidates

_UNIT, _GROUP = ["cs_id", "unit_id"], ["cs_id", "grp"]


def _found(rows: DataFrame, rule: str, item: str | Column) -> DataFrame:
    item = F.col(item) if isinstance(item, str) else item
    return rows.select("cs_id", F.lit(rule).alias("rule"), item.cast("string").alias("item"))


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")


def unit_rules(units: DataFrame, edges: DataFrame) -> list[DataFrame]:
    """Units and edges: no id twice, both ends known, no edge to itself."""
    ends = edges.select("cs_id", F.explode(F.array("src", "dst")).alias("unit_id")).distinct()
    pair = F.concat_ws(">", "src", "dst")
    return [
        _found(repeated(units, _UNIT), "unit-repeated", "unit_id"),
        _found(repeated(edges, ["cs_id", "src", "dst", "kind"]), "edge-repeated", pair),
        _found(edges.where("src = dst"), "edge-to-itself", pair),
        _found(ends.join(units, _UNIT, "left_anti"), "end-unknown", "unit_id"),
    ]


def cover_rules(units: DataFrame, membership: DataFrame) -> list[DataFrame]:
    """Each unit lies in exactly one group, and groups hold known units only."""
    return [
        _found(units.select(*_UNIT).distinct().join(membership, _UNIT, "left_anti"), "unit-left-out", "unit_id"),
        _found(repeated(membership, _UNIT), "unit-in-two-groups", "unit_id"),
        _found(membership.join(units, _UNIT, "left_anti"), "member-unknown", "unit_id"),
    ]


def order_rules(edges: DataFrame, membership: DataFrame) -> list[DataFrame]:
    """No hard edge is cut and no ordered edge runs backwards."""
    e, pair = edge_groups(edges, membership), F.concat_ws(">", "src", "dst")
    return [
        _found(e.where(holds_together(edges) & (F.col("src_grp") != F.col("dst_grp"))), "hard-edge-cut", pair),
        _found(e.where("kind = 'before' AND src_grp > dst_grp"), "order-inverted", pair),
    ]


def claim_rules(units: DataFrame, edges: DataFrame, membership: DataFrame, totals: DataFrame, needs: DataFrame, hard_lines: int = HARD_LINES, hard_files: int = HARD_FILES) -> list[DataFrame]:
    """What a plan says of its groups, ``totals`` (cs_id, grp, added, deleted, files) and ``needs`` (cs_id, grp, needs), against the same derived anew, and against the hard limits."""
    real = group_totals(units, membership)
    both = totals.select(*_GROUP, *[F.col(c).alias(f"_{c}") for c in ("added", "deleted", "files")]).join(real, _GROUP, "full")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("added", "deleted", "files")])
    e = edge_groups(edges, membership).where("kind = 'before' AND src_grp <> dst_grp")
    real_needs = e.select("cs_id", F.col("dst_grp").alias("grp"), F.col("src_grp").alias("needs")).distinct()
    key, item = [*_GROUP, "needs"], F.concat_ws("<", "needs", "grp")
    return [
        _found(real.where((F.col("added") + F.col("deleted") > hard_lines) | (F.col("files") > hard_files)), "group-too-large", "grp"),
        _found(both.where(~same), "totals-differ", "grp"),
        _found(real_needs.join(needs, key, "left_anti"), "dependency-missing", item),
        _found(needs.distinct().join(real_needs, key, "left_anti"), "dependency-unfounded", item),
        _found(needs.where("needs >= grp"), "dependency-not-earlier", item),
    ]


def hunk_rules(files: DataFrame, hunks: DataFrame, units: DataFrame, unit_hunks: DataFrame) -> DataFrame:
    """Every hunk of ``hunks`` (cs_id, file_id, hunk_id) lies in exactly one unit of its file; files have units, atomic ones a single one with all hunks.

    files: cs_id, file_id, is_atomic. units: cs_id, unit_id, file_id, is_atomic. unit_hunks: cs_id, unit_id, hunk_id.
    """
    file, hunk = ["cs_id", "file_id"], ["cs_id", "hunk_id"]
    assigned = unit_hunks.join(units.select(*_UNIT, "file_id"), _UNIT).select(*hunk, *_UNIT[1:], "file_id")
    of_file = units.join(files.select(*file, F.col("is_atomic").alias("_atomic")), file)
    n = of_file.groupBy(*file).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("_atomic") | F.col("is_atomic")).alias("whole"))
    own = of_file.where("is_atomic").select(*_UNIT, "file_id").join(hunks.select("cs_id", "file_id", "hunk_id"), file)
    return reduce(DataFrame.unionByName, [
        _found(units.join(files, file, "left_anti"), "file-unknown", "unit_id"),
        _found(files.join(units, file, "left_anti"), "file-left-out", "file_id"),
        _found(assigned.join(hunks, [*hunk, "file_id"], "left_anti"), "hunk-of-another-file", "hunk_id"),
        _found(repeated(assigned, hunk), "hunk-in-two-units", "hunk_id"),
        _found(hunks.join(assigned, hunk, "left_anti"), "hunk-left-out", "hunk_id"),
        _found(of_file.where("_atomic AND NOT is_atomic"), "atomic-file-split", "unit_id"),
        _found(n.where("whole AND n > 1"), "atomic-file-in-units", "file_id"),
        _found(own.join(unit_hunks, [*_UNIT, "hunk_id"], "left_anti"), "atomic-unit-incomplete", "hunk_id"),
    ])


def claimed_fields(claimed: DataFrame, derived: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(cs_id, rule: the field, item: the last of ``key``) wherever a row claims another value than the one derived anew."""
    both = claimed.select(*key, F.struct(*fields).alias("_a")).join(derived.select(*key, F.struct(*fields).alias("_b")), key)
    wrong = F.filter(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    return both.select("cs_id", F.explode(wrong).alias("rule"), F.col(key[-1]).cast("string").alias("item"))


def plan_violations(units: DataFrame, edges: DataFrame, membership: DataFrame, totals: DataFrame, needs: DataFrame) -> DataFrame:
    """All rules. Rows with null keys join nothing, so they come out as left out or unknown; empty tables give no rows."""
    rules = unit_rules(units, edges) + cover_rules(units, membership) + order_rules(edges, membership) + claim_rules(units, edges, membership, totals, needs)
    return reduce(DataFrame.unionByName, rules)


def field_changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, field, old_value, new_value) for every field that differs between rows of equal keys; a row on one side only has one line, with field null."""
    fields = [c for c in old.columns if c not in key and c in new.columns]
    side = lambda df, name: df.select(*key, F.struct(*[F.col(c).cast("string").alias(c) for c in fields]).alias(name))
    both = side(old, "_old").join(side(new, "_new"), key, "full")
    lines = [F.struct(F.lit(c).alias("field"), F.col("_old")[c].alias("old_value"), F.col("_new")[c].alias("new_value")) for c in fields]
    missing = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.col("_old").isNotNull().cast("string").alias("old_value"), F.col("_new").isNotNull().cast("string").alias("new_value")))
    differ = F.filter(F.array(*lines), lambda x: ~x["old_value"].eqNullSafe(x["new_value"]))
    found = F.when(F.col("_old").isNull() | F.col("_new").isNull(), missing).otherwise(differ)
    return both.select(*key, F.explode(found).alias("_x")).select(*key, "_x.*")


def candidate_rules(units: DataFrame, edges: DataFrame, claimed: DataFrame, repaired: DataFrame | None = None, limits: Limits = DEFAULT) -> DataFrame:
    """Candidates that a plan claims (cs_id, rank, candidate_id, cost, groups) against the same derived anew; after a repair, in ``repaired`` (cs_id), there may be none."""
    real = candidates(units, edges, limits)
    if repaired is not None:
        real = real.join(repaired.select("cs_id").distinct(), "cs_id", "left_anti")
    key, fields = ["cs_id", "rank"], ("candidate_id", "cost", "groups")
    both = claimed.select(*key, F.struct(*fields).alias("_claim")).join(real.select(*key, F.struct(*fields).alias("_real")), key, "full")
    item = F.concat_ws(":", F.col("rank"), F.coalesce("_claim.candidate_id", "_real.candidate_id"))
    return reduce(DataFrame.unionByName, [
        _found(both.where("_claim IS NULL"), "candidate-missing", item), _found(both.where("_real IS NULL"), "candidate-unfounded", item),
        _found(both.where("_claim IS NOT NULL AND _real IS NOT NULL AND NOT _claim <=> _real"), "candidate-differs", item),
    ])


def metric_rules(claimed: DataFrame, derived: DataFrame) -> DataFrame:
    """(cs_id, rule, item): plans whose metrics (reviewability, cohesion, integrity) differ from those derived anew, and those that claim more confidence than what is derived, or
    one that isn't known. A plan that claims nothing has its fields null."""
    levels = F.array(*map(F.lit, ("low", "medium", "high")))
    fields = ["reviewability", "cohesion", "integrity", "confidence"]
    both = derived.select("cs_id", F.struct(*fields).alias("_b")).join(claimed.select("cs_id", F.struct(*fields).alias("_a")), "cs_id", "left")
    level = lambda side: F.coalesce(F.array_position(levels, F.col(f"{side}.confidence")), F.lit(0))
    differs = [F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(f"{c}-differs")) for c in fields[:3]]
    beyond = F.when((level("_a") == 0) | (level("_a") > level("_b")), F.lit("confidence-above-evidence"))
    return both.select("cs_id", F.explode(F.array_compact(F.array(*differs, beyond))).alias("rule"), F.col("cs_id").cast("string").alias("item"))
