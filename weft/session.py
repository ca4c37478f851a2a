"""Session, table access and lineage helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


#: Rows of a change-set lie together (``bucketed``), so joins by change-set and more columns needn't deal them out again.
SETTINGS = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def session(app: str = "weft", master: str | None = None) -> SparkSession:
    """A session with the settings the queries are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config(map=SETTINGS)
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in local mode where none is named (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back, so later branches don't repeat its work."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of the largest table that one task works on, by and large; with more of them tables are dealt into more parts, so that what a task holds doesn't grow.
PART_ROWS = 150_000
_PARTS = "weft.parts"


def set_parts(spark: SparkSession, rows: int) -> int:
    """Parts for a query whose largest table has ``rows`` rows: a multiple of the shuffle partitions. ``bucketed`` uses as many from then on, as tables that are joined
    have to agree; the next query starts anew (``ship_package``)."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = least * max(1, -(-rows // (PART_ROWS * least)))
    spark.conf.set(_PARTS, str(parts))
    return parts


def bucketed(df: DataFrame, name: str, key: str | list[str], buckets: int | None = None) -> DataFrame:
    """``df`` written to the shared folder, dealt by ``key``, and read back: joins and groupings by ``key`` don't shuffle it, nor by more columns than that (see ``SETTINGS``)."""
    spark, own = df.sparkSession, f"weft_{name}_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get(_PARTS, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", shared_path(spark, name)).option("compression", "zstd").saveAsTable(own)
    found = spark.table(own)
    spark.sql(f"DROP TABLE {own}")  # the files stay, and the plan above knows them
    return found


def ship_package(spark: SparkSession) -> None:
    """Apply ``SETTINGS``, and send this package to the executors once a session, so that they need no path to it."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    spark.conf.unset(_PARTS)
    context = spark.sparkContext
    if getattr(context, "_weft_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "weft.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("weft", os.path.relpath(path, here)))
    context.addPyFile(target)
    context._weft_shipped = True
