"""Outcomes of checks on a plan's prefixes.

results: cs_id, grp, pos (from 0), name, status (passed, failed, skipped, timeout, unavailable). A group's results stand in order:
reconstruction, then either a snapshot that couldn't be made, or (dependencies, if they can't be had,) syntax, semantic and the project's
own checks. Places tell them apart, since a project's check may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Diagnostic codes that speak of the environment, and the two of them that don't for a relative module.
ENVIRONMENT_CODES = [2307, 2318, 2688, 2792, 5058, 6053, 6305, 7016]
MODULE_CODES = [2307, 2792]


def group_outcomes(results: DataFrame) -> DataFrame:
    """(cs_id, grp, syntax, semantic, covered, commands, any_failed, any_unavailable) of each group; null syntax and semantic where no snapshot could be made."""
    at = lambda i: F.max(F.when(F.col("pos") == i, F.struct("name", "status")))
    g = results.groupBy("cs_id", "grp").agg(
        *[at(i).alias(f"r{i}") for i in (1, 2, 3)],
        F.bool_or(F.col("status").isin("failed", "timeout")).alias("any_failed"), F.bool_or(F.col("status") == "unavailable").alias("any_unavailable"),
        *[F.coalesce(F.bool_and(F.when(F.col("pos") >= i, F.col("status") == "passed")), F.lit(True)).alias(f"own{i}") for i in (3, 4)],
        *[F.coalesce(F.bool_or(F.when(F.col("pos") >= i, F.col("status") != "skipped")), F.lit(False)).alias(f"ran{i}") for i in (3, 4)],
    )
    no_snapshot, late = F.col("r1.name") == "snapshot", F.col("r1.name") == "dependencies"
    place = lambda a, b: F.when(no_snapshot, None).when(late, F.col(b)).otherwise(F.col(a))
    g = g.select("*", place("r1.status", "r2.status").alias("syntax"), place("r2.status", "r3.status").alias("semantic"), F.coalesce(place("ran3", "ran4"), F.lit(False)).alias("commands"))
    covered = ~late & (F.col("syntax") == "passed") & F.col("semantic").isin("passed", "skipped") & F.col("own3")
    return g.select("cs_id", "grp", "syntax", "semantic", F.coalesce(covered, F.lit(False)).alias("covered"), "commands", "any_failed", "any_unavailable")


def verification(results: DataFrame, groups: DataFrame) -> DataFrame:
    """(cs_id, status, level, plan_status, covered, total, commands) of each change-set. ``groups`` (cs_id, grp); a group without results counts as not covered."""
    every = groups.select("cs_id", "grp").distinct().join(group_outcomes(results), ["cs_id", "grp"], "left")
    g = every.groupBy("cs_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("covered", F.lit(False))).alias("covered"), F.coalesce(F.bool_or("commands"), F.lit(False)).alias("commands"),
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("any_failed", "any_unavailable")],
        *[(F.count_if(F.col(c) == "passed") == F.count(F.lit(1))).alias(f"all_{c}") for c in ("syntax", "semantic")],
    )
    status = F.when(F.col("any_failed"), "failed").when(F.col("any_unavailable"), "verification-unavailable").otherwise("passed")
    g = g.withColumn("status", status)
    level = F.when(F.col("commands") & (F.col("status") == "passed"), "project").when(F.col("all_semantic"), "semantic").when(F.col("all_syntax"), "syntax").otherwise("reconstructed")
    plan = F.when(F.col("total") <= 1, "single-change").when(F.col("status") == "passed", "split-verified").otherwise("split-unverified")
    return g.select("cs_id", "status", level.alias("level"), plan.alias("plan_status"), "covered", "total", "commands")


def is_environment(code: Column, message: Column) -> Column:
    """Whether a diagnostic is about what is installed. A relative module that is missing is a fault of the change."""
    named = F.regexp_extract(message, "['\"]([^'\"]*)['\"]", 1)  # what the message quotes first
    relative = code.isin(MODULE_CODES) & (named.startswith("./") | named.startswith("../"))
    return code.isin(ENVIRONMENT_CODES) & ~F.coalesce(relative, F.lit(False))


def diagnosed(diagnostics: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(cs_id, grp, syntax, semantic): outcomes from ``diagnostics`` (cs_id, grp, phase 'syntax' or 'semantic', code, message) on ``prefixes`` (cs_id, grp,
    configured: has a project configuration; complete: was read without limits or errors)."""
    about = is_environment(F.col("code"), F.col("message"))
    found = diagnostics.groupBy("cs_id", "grp").agg(
        F.count_if(F.col("phase") == "syntax").alias("wrong"), F.count_if(F.col("phase") == "semantic").alias("ill"), F.count_if((F.col("phase") == "semantic") & about).alias("absent")
    )
    p = prefixes.join(found, ["cs_id", "grp"], "left").fillna(0, ["wrong", "ill", "absent"])
    syntax = F.when(F.col("wrong") > 0, "failed").when(F.col("complete"), "passed").otherwise("unavailable")
    semantic = F.when(~F.col("configured") | ~F.col("complete") | (F.col("absent") > 0), "unavailable").when(F.col("wrong") + F.col("ill") > 0, "failed").otherwise("passed")
    return p.select("cs_id", "grp", syntax.alias("syntax"), semantic.alias("semantic"))
