"""Status rollups over check results (cs_id, grp, name, status)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.identity import edge_id


def status_rollup(results: DataFrame) -> DataFrame:
    """Per change-set: failed if any check failed, passed if all passed, else partial; and passed out of total."""
    state = F.when(F.bool_or(F.col("status") == "failed"), "failed").when(F.bool_and(F.col("status") == "passed"), "passed").otherwise("partial")
    return results.groupBy("cs_id").agg(state.alias("state"), F.count_if(F.col("status") == "passed").alias("passed"), F.count(F.lit(1)).alias("total"))


def outcomes(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def repair(results: DataFrame) -> DataFrame:
    """Groups merged with the next after a failure: each group's new number. A failed group that is the last stays."""
    from pyspark.sql import Window as W

    bad = results.groupBy("cs_id", "grp").agg(F.bool_or(F.col("status") == "failed").alias("bad"))
    w = W.partitionBy("cs_id").orderBy("grp")
    return bad.select("cs_id", "grp", (F.row_number().over(w) - F.coalesce(F.sum(F.col("bad").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).cast("bigint").alias("merged_grp"))


def incident_edges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Every group with the edges that have an end in it: (grp and the columns of ``edges``)."""
    either = edges.select("*", F.explode(F.array("src", "dst")).alias("unit_id"))
    return either.join(membership, ["cs_id", "unit_id"]).drop("unit_id").distinct()


def explained_edges(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """The ``edges`` that ``asked`` (cs_id, edge) names, by id or as FROM:TO."""
    names = edges.select("*", F.explode(F.array(edge_id(F.col("src"), F.col("dst"), F.col("kind")), F.concat_ws(":", "src", "dst"))).alias("edge"))
    return names.join(asked, ["cs_id", "edge"], "left_semi").drop("edge").distinct()


def explained_groups(groups: DataFrame, asked: DataFrame) -> DataFrame:
    """(cs_id, name, grp): the group (cs_id, grp, id) that each of ``asked`` (cs_id, name) means, by its id or, if none has it, as slice-N by its place."""
    by_id = asked.join(groups.select("cs_id", F.col("id").alias("name"), "grp"), ["cs_id", "name"])
    place = asked.join(by_id, ["cs_id", "name"], "left_anti").withColumn("grp", F.regexp_extract("name", "^slice-([0-9]+)$", 1).try_cast("bigint"))
    return by_id.unionByName(place.join(groups.select("cs_id", "grp"), ["cs_id", "grp"], "left_semi").select("cs_id", "name", "grp"))
