"""Verification with repair: the groups of all plans are checked in order, and where a prefix fails, its last group is merged with the next one and the plan is checked
again. Plans that have no failing prefix left, but for the last, are settled and leave; the others go on, all at once, so rounds are as many as the plan with
the most repairs needs, and each round works on what is left.

groups: cs_id, grp (place in the plan, from 1), group_id, title, unit_ids, depends_on (ids of groups), files, added, deleted, reasons (texts).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import identity
from weft.operators import groups as group_rules
from weft.session import materialize

#: The longest title put together from titles, the reason of a merge, and the words of a shorter title.
LONGEST_TITLE, REASON, UNITS = 1000, "Adjacent groups merged after an intermediate prefix failed verification.", "unità"


def first_failures(groups: DataFrame, failed: DataFrame) -> DataFrame:
    """(cs_id, at): the first group of each plan whose prefix failed (cs_id, grp of ``failed``), where another group follows it."""
    last = groups.groupBy("cs_id").agg(F.max("grp").alias("_last"))
    first = failed.groupBy("cs_id").agg(F.min("grp").alias("at"))
    return first.join(last, "cs_id").where("at < _last").select("cs_id", "at")


def merged_following(groups: DataFrame, at: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """``groups`` of the plans in ``at`` (cs_id, at) with group ``at`` and the next one made one, and what depended on either depending on it.

    ``units`` (what ``titles`` takes) gives merged groups their own title where both together would be too long.
    """
    rows = groups.join(at, "cs_id").withColumn("place", F.col("grp") - F.when(F.col("grp") > F.col("at"), 1).otherwise(0)).withColumn("merged", F.col("grp").isin(F.col("at"), F.col("at") + 1))
    parts = F.array_sort(F.collect_list(F.struct("grp", "group_id", "title", "unit_ids", "depends_on", "files", "reasons")))
    both = rows.groupBy("cs_id", F.col("place").alias("grp"), "merged").agg(parts.alias("p"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    every = lambda name: F.flatten(F.transform("p", lambda g: g[name]))
    ids, of = F.transform("p", lambda g: g["group_id"]), every("unit_ids")
    out = both.select(
        "cs_id", "grp", "merged", ids.alias("removed"), F.when(F.col("merged"), identity.list_id("slice", of)).otherwise(F.get(ids, F.lit(0))).alias("group_id"),
        F.array_join(F.transform("p", lambda g: g["title"]), " + ").alias("title"), of.alias("unit_ids"), F.array_except(F.array_distinct(every("depends_on")), ids).alias("depends_on"),
        F.when(F.col("merged"), F.array_sort(F.array_distinct(every("files")))).otherwise(every("files")).alias("files"), "added", "deleted",
        F.concat(every("reasons"), F.when(F.col("merged"), F.array(F.concat(F.lit(f"{REASON} "), F.array_join(F.transform("p", lambda g: g["title"]), " | ")))).otherwise(F.array().cast("array<string>"))).alias("reasons"),
    )
    if units is not None:
        long = out.where(F.col("merged") & (F.length("title") > LONGEST_TITLE))
        own = group_rules.titles(units, long.select("cs_id", "grp", F.explode("unit_ids").alias("unit_id"))).select("cs_id", "grp", F.col("title").alias("own"))
        short = F.concat("own", F.lit(" ["), F.size("unit_ids").cast("string"), F.lit(f" {UNITS}]"))
        out = out.join(own, ["cs_id", "grp"], "left").withColumn("title", F.when(F.col("own").isNotNull(), short).otherwise(F.col("title"))).drop("own")
    new = out.where("merged").select("cs_id", F.col("removed").alias("gone"), F.col("group_id").alias("now"))
    renamed = F.array_distinct(F.transform("depends_on", lambda d: F.when(F.array_contains("gone", d), F.col("now")).otherwise(d)))
    return out.join(new, "cs_id").withColumn("depends_on", F.array_remove(renamed, F.col("group_id"))).drop("merged", "removed", "gone", "now")


def repaired(groups: DataFrame, check: Callable[[DataFrame], DataFrame], units: DataFrame | None = None, hard_lines: int = group_rules.HARD_LINES, hard_files: int = group_rules.HARD_FILES) -> DataFrame:
    """The settled ``groups``, with repairs (how many merges their plan took) and over_limit (whether the group was merged beyond a hard limit).

    ``check`` takes the groups of the plans that aren't settled and gives (cs_id, grp) of each group whose prefix failed or timed out. A plan takes
    fewer rounds than it has groups; an empty table gives an empty result.
    """
    kept = ["cs_id", "grp", "group_id", "title", "unit_ids", "depends_on", "files", "added", "deleted", "reasons"]
    live = materialize(groups.select(*kept).withColumns({"repairs": F.lit(0), "over_limit": F.lit(False)}), "repairs")
    most = live.agg(F.max("grp").alias("n")).first()["n"] or 0
    settled = []
    for _ in range(max(1, most)):
        at = materialize(first_failures(live, check(live)), "repairs")
        settled.append(live.join(at, "cs_id", "left_anti"))
        if not at.limit(1).count():
            break
        state = live.join(at, "cs_id").select("cs_id", (F.col("grp") - F.when(F.col("grp") > F.col("at"), 1).otherwise(0)).alias("grp"), F.col("grp").isin(F.col("at"), F.col("at") + 1).alias("hit"), "repairs", "over_limit")
        state = state.groupBy("cs_id", "grp").agg(F.bool_or("hit").alias("hit"), (F.max("repairs") + 1).alias("repairs"), F.bool_or("over_limit").alias("was"))
        over = F.col("was") | (F.col("hit") & ((F.size("files") > hard_files) | (F.col("added") + F.col("deleted") > hard_lines)))
        live = materialize(merged_following(live.select(*kept), at, units).join(state, ["cs_id", "grp"]).withColumn("over_limit", over).select(*kept, "repairs", "over_limit"), "repairs")
    return reduce(DataFrame.unionByName, settled)
