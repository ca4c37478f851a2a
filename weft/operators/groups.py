"""Groups of change units: totals, dependencies, penalties, costs, metrics and constraint checks.

Tables: units (cs_id, unit_id, file, package, area, added, deleted, is_test, is_generated), edges (cs_id, src, dst,
kind, weight), membership (cs_id, unit_id, grp: the group's position from 1).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TARGET_LINES, TARGET_FILES, HARD_LINES, HARD_FILES = 350, 12, 800, 30


def holds_together(edges: DataFrame) -> Column:
    """Whether an edge's ends must share a group: must_with, and edges of unknown kind that say so in a flag requires_together (if there is such a column)."""
    hard = F.col("kind") == "must_with"
    if "requires_together" in edges.columns:
        hard |= (F.col("kind") == "unknown") & F.coalesce("requires_together", F.lit(False))
    return hard


def group_totals(units: DataFrame, membership: DataFrame) -> DataFrame:
    """Per group: units, lines, lines to review (generated ones left out), files, packages, areas."""
    lines = F.col("added") + F.col("deleted")
    return units.join(membership, ["cs_id", "unit_id"]).groupBy("cs_id", "grp").agg(
        F.count(F.lit(1)).alias("n_units"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"),
        F.sum(F.when(F.col("is_generated"), 0).otherwise(lines)).alias("review_lines"), F.count_distinct("file").alias("files"),
        F.count_distinct("package").alias("packages"), F.count_distinct("area").alias("areas"), F.bool_and("is_test").alias("all_tests"),
    )


def edge_groups(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Edges with the groups of both ends."""
    a = membership.select("cs_id", F.col("unit_id").alias("src"), F.col("grp").alias("src_grp"))
    b = membership.select("cs_id", F.col("unit_id").alias("dst"), F.col("grp").alias("dst_grp"))
    return edges.join(a, ["cs_id", "src"]).join(b, ["cs_id", "dst"])


def group_dependencies(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Distinct earlier groups that a group needs, by ``before`` edges."""
    e = edge_groups(edges, membership).where((F.col("kind") == "before") & (F.col("src_grp") < F.col("dst_grp")))
    return e.groupBy("cs_id", F.col("dst_grp").alias("grp")).agg(F.array_join(F.array_sort(F.collect_set("src_grp")), ",").alias("depends_on"))


def violations(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Per change-set: hard edges cut between groups and ``before`` edges against the order of groups."""
    e = edge_groups(edges, membership)
    cut = holds_together(edges) & (F.col("src_grp") != F.col("dst_grp"))
    back = (F.col("kind") == "before") & (F.col("src_grp") > F.col("dst_grp"))
    return e.groupBy("cs_id").agg(F.count_if(cut).alias("hard_cuts"), F.count_if(back).alias("inversions"))


def penalty(kind: Column, weight: Column, one_is_test: Column, keep_tests: bool = True, hard: Column | None = None) -> Column:
    """Cost of separating an edge's ends: none for hard edges (they can't be), a tenth of the weight for ordered ones, more for affinity."""
    w = F.least(F.greatest(weight.cast("double"), F.lit(0.0)), F.lit(100.0))
    near = F.when(one_is_test & F.lit(keep_tests), 0.8).otherwise(0.4)
    return F.when(kind == "must_with" if hard is None else hard, 0.0).when(kind == "unknown", F.greatest(F.lit(40.0), w)).when(kind == "before", 0.1 * w).otherwise(near * w)


def edge_penalties(units: DataFrame, edges: DataFrame) -> DataFrame:
    """Total penalty of each change-set's edges by kind, in tenths so that sums are exact."""
    t = units.select("cs_id", F.col("unit_id").alias("src"), F.col("is_test").alias("src_test"))
    u = units.select("cs_id", F.col("unit_id").alias("dst"), F.col("is_test").alias("dst_test"))
    e = edges.join(t, ["cs_id", "src"]).join(u, ["cs_id", "dst"])
    tenths = F.floor(10 * penalty(F.col("kind"), F.col("weight"), F.col("src_test") != F.col("dst_test")) + 0.5).cast("bigint")
    return e.groupBy("cs_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(tenths).alias("penalty_tenths"))


def segment_cost(lines: Column, files: Column, packages: Column, areas: Column, target_lines: int = TARGET_LINES, target_files: int = TARGET_FILES) -> Column:
    """Cost of one group: a fixed part, distance from the target sizes, and packages and areas beyond one."""
    size, spread = lines / F.greatest(F.lit(1), F.lit(target_lines)), files / F.greatest(F.lit(1), F.lit(target_files))
    over = lambda x: F.greatest(F.lit(0.0), x)
    return 8 + 35 * F.pow(over(size - 1), 2) + 10 * over(0.25 - size) + 12 * F.pow(over(spread - 1), 2) + 18 * over(packages - 1) + 24 * over(areas - 1)


def segment_cost_of(review, files, packages, areas, target_lines: int = TARGET_LINES, target_files: int = TARGET_FILES):
    """``segment_cost`` of numpy arrays."""
    size, spread = review / max(1, target_lines), files / max(1, target_files)
    over = lambda x: np.maximum(0.0, x)
    return 8 + 35 * over(size - 1) ** 2 + 10 * over(0.25 - size) + 12 * over(spread - 1) ** 2 + 18 * over(packages - 1) + 24 * over(areas - 1)


def group_costs(totals: DataFrame) -> DataFrame:
    """Cost of each group in millionths, and whether it passes a hard limit."""
    cost = segment_cost(F.col("review_lines"), F.col("files"), F.col("packages"), F.col("areas"))
    over = (F.col("added") + F.col("deleted") > HARD_LINES) | (F.col("files") > HARD_FILES)
    return totals.select("cs_id", "grp", F.floor(cost * 1000 + 0.5).cast("bigint").alias("cost_thousandths"), over.alias("infeasible"))


def metrics(units: DataFrame, edges: DataFrame, membership: DataFrame, target_lines: int = TARGET_LINES, target_files: int = TARGET_FILES) -> DataFrame:
    """Per change-set: reviewability, structural cohesion and dependency integrity, each 0 to 100, rounded to hundredths."""
    rounded = lambda x: F.floor(x * 10000 + 0.5) / 100
    totals = group_totals(units, membership)
    easy = F.least(F.lit(1.0), F.lit(float(target_lines)) / F.greatest(F.lit(1), F.col("review_lines")), F.lit(float(target_files)) / F.greatest(F.lit(1), F.col("files")))
    review = totals.groupBy("cs_id").agg(rounded(F.sum(F.floor(easy * 1000000 + 0.5)) / 1000000 / F.count(F.lit(1))).alias("reviewability"))
    e = edge_groups(edges, membership)
    same, hard = F.col("src_grp") == F.col("dst_grp"), holds_together(edges) | (F.col("kind") == "before")
    kept = F.when(holds_together(edges), same).otherwise(F.col("src_grp") <= F.col("dst_grp"))
    sums = e.groupBy("cs_id").agg(
        F.sum(F.when(F.col("kind") == "affinity", F.col("weight"))).alias("affinity"), F.sum(F.when((F.col("kind") == "affinity") & same, F.col("weight")).otherwise(0)).alias("retained"),
        F.count_if(hard).alias("hard"), F.count_if(hard & kept).alias("satisfied"),
    )
    part = lambda a, b: F.when(F.coalesce(b, F.lit(0)) == 0, 100.0).otherwise(rounded(a / b))
    return review.join(sums, "cs_id", "left").select(
        "cs_id", "reviewability", part(F.col("retained"), F.col("affinity")).alias("cohesion"), part(F.col("satisfied"), F.col("hard")).alias("integrity")
    )


def strong_boundaries(edges: DataFrame, membership: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct strong ``before`` pairs across each boundary between groups. Boundaries are few for each change-set; each edge counts for those it spans."""
    e = edge_groups(edges, membership).where((F.col("kind") == "before") & (F.col("weight") >= 90) & (F.col("src_grp") < F.col("dst_grp")))
    spans = e.select("cs_id", "src", "dst", F.explode(F.sequence(F.col("src_grp"), F.col("dst_grp") - 1)).alias("boundary"))
    counts = spans.groupBy("cs_id", "boundary").agg(F.count_distinct("src", "dst").alias("pairs"))
    last = groups.groupBy("cs_id").agg(F.max("grp").alias("last"))
    every = last.where("last > 1").select("cs_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("last") - 1)).alias("boundary"))
    return every.join(counts, ["cs_id", "boundary"], "left").groupBy("cs_id").agg(
        F.min(F.coalesce("pairs", F.lit(0))).alias("least_pairs"), F.bool_and(F.coalesce("pairs", F.lit(0)) >= 2).alias("all_strong")
    )


def previous_occurrences(units: DataFrame) -> DataFrame:
    """For each unit: the position of the last one before it with the same package, and with the same area; 0 for none."""
    by = lambda c: W.partitionBy("cs_id", c).orderBy("pos")
    return units.select("cs_id", "unit_id", F.lag("pos", 1, 0).over(by("package")).alias("prev_package"), F.lag("pos", 1, 0).over(by("area")).alias("prev_area"))


def neighbours(units: DataFrame) -> DataFrame:
    """Units beside each unit in its area, the candidate pairs of large change-sets."""
    w = W.partitionBy("cs_id", "area").orderBy("unit_id")
    return units.select("cs_id", "unit_id", F.lag("unit_id").over(w).alias("before"), F.lead("unit_id").over(w).alias("after"))


def prefixes(totals: DataFrame) -> DataFrame:
    """Running totals of groups in order."""
    w = W.partitionBy("cs_id").orderBy("grp").rowsBetween(W.unboundedPreceding, 0)
    return totals.select("cs_id", "grp", F.sum("n_units").over(w).alias("units_so_far"), F.sum(F.col("added") + F.col("deleted")).over(w).alias("lines_so_far"))


# Words of titles.
ADD, REMOVE, UPDATE_TESTS, UPDATE, ANY, FILES = "Aggiungi", "Rimuovi", "Aggiorna i test di", "Aggiorna", "modifiche", "file"


def titles(units: DataFrame, membership: DataFrame) -> DataFrame:
    """(cs_id, grp, title): what is done, to the only area, else the only package, else the first file's name, and the number of files beyond one.

    ``units`` also has change_kind. Null areas and packages don't count. Texts are cut to 160 characters; escape them where they are shown.
    """
    all_of = lambda kind: F.bool_and(F.coalesce(F.col("change_kind") == kind, F.lit(False)))
    g = units.join(membership, ["cs_id", "unit_id"]).groupBy("cs_id", "grp").agg(
        all_of("add").alias("added"), all_of("delete").alias("deleted"), F.bool_and("is_test").alias("tests"), F.count_distinct("file").alias("files"),
        *[F.min(c).cast("string").alias(c) for c in ("area", "package")], *[(F.count_distinct(c) == 1).alias(f"one_{c}") for c in ("area", "package")],
        F.min_by(F.col("file").cast("string"), F.encode(F.col("file").cast("string"), "UTF-16BE")).alias("first"),
    )
    action = F.when(F.col("added"), ADD).when(F.col("deleted"), REMOVE).when(F.col("tests"), UPDATE_TESTS).otherwise(UPDATE)
    subject = F.when(F.col("one_area"), F.col("area")).when(F.col("one_package"), F.col("package")).otherwise(F.coalesce(F.regexp_replace("first", "^.*/", ""), F.lit(ANY)))
    more = F.when(F.col("files") > 1, F.concat(F.lit(" ("), F.col("files").cast("string"), F.lit(f" {FILES})"))).otherwise("")
    return g.select("cs_id", "grp", F.substring(F.translate(F.concat(action, F.lit(" "), subject, more), "\r\n\t", "   "), 1, 160).alias("title"))


# Kinds of evidence that support a boundary.
STRONG = [
    "new-symbol-reference", "removed-symbol-reference", "new-module-import", "removed-module-import", "import-binding-change", "removed-import-binding",
    "new-package-dependency", "removed-package-dependency",
]


def confidence(edges: DataFrame, membership: DataFrame, coarse: DataFrame | None = None) -> DataFrame:
    """(cs_id, confidence): low with no edges, an edge of unknown kind, or in ``coarse`` (cs_id; too many components for exact boundaries); high if there is more
    than one group, no hard edge is broken, nine tenths of the affinity are kept and every boundary has two strong pairs; else medium. Edges may have
    ``evidence``; those that don't have a strong kind then support no boundary."""
    e = edge_groups(edges, membership)
    same = F.col("src_grp") == F.col("dst_grp")
    broken = holds_together(edges) & ~same | (F.col("kind") == "before") & (F.col("src_grp") > F.col("dst_grp"))
    sums = e.groupBy("cs_id").agg(
        F.bool_or(F.col("kind") == "unknown").alias("unknown"), F.bool_or(broken).alias("broken"),
        F.sum(F.when(F.col("kind") == "affinity", F.col("weight")).otherwise(0)).alias("affinity"), F.sum(F.when((F.col("kind") == "affinity") & same, F.col("weight")).otherwise(0)).alias("retained"),
    )
    strong = edges.where(F.col("evidence").isin(STRONG)) if "evidence" in edges.columns else edges
    boundaries = strong_boundaries(strong, membership, membership)
    every = membership.groupBy("cs_id").agg(F.count_distinct("grp").alias("groups")).join(sums, "cs_id", "left").join(boundaries, "cs_id", "left")
    every = every.join(coarse.select("cs_id", F.lit(True).alias("coarse")).distinct(), "cs_id", "left") if coarse is not None else every.withColumn("coarse", F.lit(False))
    low = F.col("unknown").isNull() | F.col("unknown") | F.coalesce("coarse", F.lit(False))
    high = (F.col("groups") > 1) & ~F.col("broken") & ((F.col("affinity") == 0) | (F.col("retained") >= 0.9 * F.col("affinity"))) & F.coalesce("all_strong", F.lit(False))
    return every.select("cs_id", F.when(low, "low").when(high, "high").otherwise("medium").alias("confidence"))


def merge_edges(edges: DataFrame) -> DataFrame:
    """Edges by unordered ends (ordered ones keep their direction): no self-edges, the greatest weight, the different pieces of evidence in order."""
    ordered = F.col("kind") == "before"
    src = F.when(ordered, F.col("src")).otherwise(F.least("src", "dst"))
    dst = F.when(ordered, F.col("dst")).otherwise(F.greatest("src", "dst"))
    return edges.where(F.col("src") != F.col("dst")).groupBy("cs_id", src.alias("src"), dst.alias("dst"), "kind").agg(F.max("weight").alias("weight"), F.array_sort(F.collect_set("evidence")).alias("evidence"))


def listed_evidence(evidence: DataFrame, membership: DataFrame, top: int = 20) -> DataFrame:
    """(cs_id, grp, evidence, n) of every group: the different pieces of ``evidence`` (cs_id, grp, seq, text) by their first place, ``top`` at most and then a mark
    that there are more; a mark of its own where there is none."""
    first = evidence.groupBy("cs_id", "grp", "text").agg(F.min("seq").alias("seq"))
    ranked_ = first.withColumn("r", F.row_number().over(W.partitionBy("cs_id", "grp").orderBy("seq", "text")))
    kept = ranked_.where(F.col("r") <= top + 1).withColumn("text", F.when(F.col("r") > top, "additional-evidence").otherwise(F.col("text")))
    lists = kept.groupBy("cs_id", "grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]).alias("evidence"))
    every = membership.select("cs_id", "grp").distinct().join(lists, ["cs_id", "grp"], "left")
    found = F.coalesce("evidence", F.array(F.lit("contiguous-segment")))
    return every.select("cs_id", "grp", found.alias("evidence"), F.size(found).alias("n"))
