"""Manifests (cs_id, path, oid, mode) before and after selected changes.

Changes: cs_id, file_id, old_path (null: added), new_path (null: deleted), new_oid, new_mode.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.identity import blob_oid
from weft.operators.hunks import apply_all
from weft.session import bucketed

_ENTRY = ["cs_id", "path", "oid", "mode"]
# Modes of files, executables, links and modules, and the forms of an object's id.
MODES = ("100644", "100755", "120000", "160000")
OID = "^([0-9a-f]{40}|[0-9a-f]{64})\\z"


def reconstruct(base: DataFrame, changes: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """The manifest after the ``selected`` (cs_id, file_id) changes, all of them without a selection: paths they leave or replace go, their new entries come."""
    if selected is not None:
        changes = changes.join(selected.select("cs_id", "file_id").distinct(), ["cs_id", "file_id"], "left_semi")
    gone = changes.select("cs_id", F.explode(F.array("old_path", "new_path")).alias("path")).where("path IS NOT NULL").distinct()
    new = changes.where("new_path IS NOT NULL").select("cs_id", F.col("new_path").alias("path"), F.col("new_oid").alias("oid"), F.col("new_mode").alias("mode"))
    return base.select(*_ENTRY).join(gone, ["cs_id", "path"], "left_anti").unionByName(new)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Entries of one manifest only, with repeats: side 'left' or 'right'. Empty for equal trees."""
    a, b = left.select(*_ENTRY), right.select(*_ENTRY)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def selection_faults(files: DataFrame, hunks: DataFrame, units: DataFrame, unit_hunks: DataFrame, selected: DataFrame) -> DataFrame:
    """(cs_id, rule, item) for what keeps the ``selected`` (cs_id, unit_id) units from being made into a tree; none for a sound selection.

    files: cs_id, file_id, is_atomic, new_path, new_oid, new_mode. hunks: cs_id, file_id, hunk_id. units: cs_id, unit_id, file_id. unit_hunks: cs_id, unit_id, hunk_id.
    """
    unit, file, hunk = ["cs_id", "unit_id"], ["cs_id", "file_id"], ["cs_id", "file_id", "hunk_id"]
    found = lambda rows, rule, item: rows.select("cs_id", F.lit(rule).alias("rule"), F.col(item).cast("string").alias("item"))
    # what is read several times is written once, dealt by change-set, so that no rule works it out again and no task holds the sorts of all rules
    kept = lambda rows, name: bucketed(rows, f"selection_{name}", "cs_id")
    dealt = lambda rows: rows.repartition("cs_id")
    counted = lambda rows, key: rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    picked = kept(counted(dealt(selected.select(*unit)), unit), "picked")
    units = kept(dealt(units.select(*unit, "file_id")).join(picked, unit, "left").withColumn("_chosen", F.col("_n").isNotNull()).drop("_n"), "units")
    chosen = units.where("_chosen").drop("_chosen")
    held = counted(chosen.join(dealt(unit_hunks.select(*unit, "hunk_id")), unit), hunk)
    own = dealt(hunks.select(*hunk)).distinct().withColumn("_held", F.lit(True))
    known = kept(held.join(own, hunk, "left"), "known")
    every = own.groupBy(*file).agg(F.count(F.lit(1)).alias("_all"))
    touched = dealt(files).join(chosen.select(*file).distinct(), file, "left_semi").join(known.groupBy(*file).agg(F.count("_held").alias("_chosen")), file, "left")
    touched = kept(touched.join(every, file, "left"), "touched")
    some = F.coalesce("_chosen", F.lit(0))
    sound = F.coalesce(F.col("new_mode").isin(*MODES) & F.col("new_oid").rlike(OID), F.lit(False))
    return reduce(DataFrame.unionByName, [
        found(picked.where("_n > 1"), "unit-selected-twice", "unit_id"),
        found(picked.join(units, unit, "left_anti"), "unit-unknown", "unit_id"),
        found(chosen.join(files, file, "left_anti"), "file-unknown", "unit_id"),
        found(known.where("_n > 1"), "hunk-selected-twice", "hunk_id"),
        found(known.where("_held IS NULL").join(touched, file, "left_semi"), "hunk-unknown", "hunk_id"),
        found(touched.where(some == 0), "file-without-hunks", "file_id"),
        found(touched.where(F.col("is_atomic") & (some > 0) & (some < F.col("_all"))), "atomic-file-in-part", "file_id"),
        found(touched.where(F.col("new_path").isNotNull() & ~sound), "entry-invalid", "file_id"),
    ])


def rebuilt(files: DataFrame) -> DataFrame:
    """Add ``oid``, the id of each file's ``base`` with its chosen ``hunks`` applied, and ``fault``: what ``apply_all`` finds, or that all hunks (``n_hunks``) don't give ``new_oid``."""
    rows = apply_all(files).withColumn("oid", blob_oid(F.col("head")))
    whole = F.coalesce((F.size("hunks") == F.col("n_hunks")) & ~F.col("oid").eqNullSafe(F.col("new_oid")) & F.col("head").isNotNull(), F.lit(False))
    return rows.withColumn("fault", F.coalesce("fault", F.when(whole, "all hunks don't give the new content"))).drop("head")
