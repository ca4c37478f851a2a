"""Plan files: JSON texts read whole, one a row, and their tables.

A plan over ``MAX_BYTES`` is refused by name rather than cut. Reading keeps the text, from which the digest is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.identity import plan_digests

MAX_BYTES = 100 << 20
UNIT = "id string, fileId string, changeKind string, syntaxKind string, oldPath string, newPath string, hunkIds array<string>, symbolIds array<string>, packageId string, area string, addedLines bigint, deletedLines bigint, isTest boolean, isGenerated boolean, isAtomic boolean"
EVIDENCE = "array<struct<type:string,message:string,symbol:string,paths:array<string>>>"
GROUP = "id string, title string, unitIds array<string>, dependsOn array<string>, files array<string>, addedLines bigint, deletedLines bigint"


def _struct(ddl: str) -> str:
    return "struct<" + ddl.replace(" ", ":", 1).replace(", ", ",").replace(" ", ":") + ">"


PLAN = (
    f"schemaVersion int, status string, files array<struct<id:string,oldPath:string,newPath:string,changeKind:string,addedLines:bigint,deletedLines:bigint>>, units array<{_struct(UNIT)}>, "
    f"edges array<struct<id:string,from:string,to:string,kind:string,weight:double,evidence:{EVIDENCE}>>, groups array<{_struct(GROUP)}>, candidates array<struct<id:string,cost:double,groups:array<{_struct(GROUP)}>>>, integrity struct<digest:string,finalTreeOid:string>"
)


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """(cs_id: the file's path, text, plan) of every plan file below ``path``. A file that isn't a plan has a null plan."""
    files = spark.read.format("binaryFile").load(path)
    small = F.when(F.col("length") > MAX_BYTES, F.raise_error(F.concat(F.lit("plan too large: "), F.col("path")))).otherwise(F.col("content"))
    text = files.select(F.col("path").alias("cs_id"), F.decode(small, "UTF-8").alias("text"))
    parsed = F.from_json("text", PLAN, {"mode": "PERMISSIVE"})
    return text.withColumn("plan", F.when(F.size(parsed["groups"]) >= 0, parsed))


def write_plans(plans: DataFrame, path: str, mode: str = "error") -> None:
    """Write (cs_id, text), one JSON text a row under a folder for each change-set."""
    plans.select("cs_id", "text").write.mode(mode).partitionBy("cs_id").text(path)


def plan_tables(plans: DataFrame) -> dict[str, DataFrame]:
    """Tables units, edges and membership of plans, as the operators take them. Positions are counted from 1."""
    unit = plans.select("cs_id", F.explode("plan.units").alias("u"))
    edge = plans.select("cs_id", F.explode("plan.edges").alias("e"))
    member = plans.select("cs_id", F.posexplode("plan.groups").alias("g", "x"))
    return {
        "units": unit.select(
            "cs_id", F.col("u.id").alias("unit_id"), F.coalesce("u.newPath", "u.oldPath", "u.id").alias("file"), F.col("u.packageId").alias("package"), F.col("u.area").alias("area"),
            F.col("u.addedLines").alias("added"), F.col("u.deletedLines").alias("deleted"), F.col("u.isTest").alias("is_test"), F.col("u.isGenerated").alias("is_generated"), F.col("u.changeKind").alias("change_kind"),
        ),
        "edges": edge.select("cs_id", F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.col("e.kind").alias("kind"), F.col("e.weight").alias("weight"), F.col("e.evidence.type")[0].alias("evidence")),
        "membership": member.select("cs_id", F.explode("x.unitIds").alias("unit_id"), (F.col("g") + 1).cast("bigint").alias("grp")),
    }


def stale(plans: DataFrame) -> DataFrame:
    """(cs_id, claimed, real): plans whose digest isn't the one of their text."""
    return plans.select("cs_id", F.col("plan.integrity.digest").alias("claimed"), plan_digests(F.col("text")).alias("real")).where("NOT claimed <=> real")
