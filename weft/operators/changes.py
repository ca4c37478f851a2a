"""Changed files from the raw and the counting form of a diff, and what follows from settings for each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.paths import first_area, matches_any
from weft.operators.hunks import LINK, MODULE

# The records of a raw and of a counting diff with NUL between fields, as Git writes them; endings of source files.
RAW = "(?s):([0-7]{6}) ([0-7]{6}) ([0-9a-f]+) ([0-9a-f]+) (?:([RC])([0-9]*)\\x00([^\\x00]+)\\x00([^\\x00]+)|([A-Z])[0-9]*\\x00([^\\x00]+))\\x00"
COUNTS = "(?s)([0-9]+|-)\t([0-9]+|-)\t(?:([^\\x00]+)|\\x00[^\\x00]+\\x00([^\\x00]+))\\x00"
SOURCE = "(?i)\\.[cm]?[jt]sx?$"
NO_FILE = "000000"


def raw_changes(diffs: DataFrame) -> DataFrame:
    """(cs_id, old_path, new_path, old_mode, new_mode, old_oid, new_oid, status, score, added, deleted) of every record of ``diffs`` (cs_id, raw, counts).

    Counts join by path, 0 where there are none or the file is binary. A null or empty text has no records.
    """
    record = diffs.select("cs_id", F.explode(F.regexp_extract_all("raw", F.lit(RAW), F.lit(0))).alias("r"))
    part = lambda i: F.regexp_extract("r", RAW, i)
    some = lambda a, b: F.when(part(a) != "", part(a)).otherwise(part(b))
    files = record.select("cs_id", *[part(i).alias(c) for i, c in ((1, "old_mode"), (2, "new_mode"), (3, "old_oid"), (4, "new_oid"))], some(5, 9).alias("status"), part(6).try_cast("int").alias("score"), some(7, 10).alias("a"), some(8, 10).alias("b"))
    files = files.select("*", F.when(F.col("status") != "A", F.col("a")).alias("old_path"), F.when(F.col("status") != "D", F.col("b")).alias("new_path"), F.col("b").alias("path"))
    count = diffs.select("cs_id", F.explode(F.regexp_extract_all("counts", F.lit(COUNTS), F.lit(0))).alias("r"))
    field = lambda i: F.regexp_extract("r", COUNTS, i)
    number = lambda i: F.coalesce(field(i).try_cast("bigint"), F.lit(0))
    sizes = count.select("cs_id", F.when(field(3) != "", field(3)).otherwise(field(4)).alias("path"), number(1).alias("added"), number(2).alias("deleted"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return files.join(sizes, ["cs_id", "path"], "left").select("cs_id", "old_path", "new_path", "old_mode", "new_mode", "old_oid", "new_oid", "status", "score", zero("added"), zero("deleted"))


def with_objects(changes: DataFrame, objects: DataFrame) -> DataFrame:
    """Add old_size, new_size and missing: whether a side's object isn't a blob of ``objects`` (oid, type, size). Sides without a file, and links to repositories, have size 0."""
    blobs = objects.where("type = 'blob'").select("oid", "size").distinct()
    for side in ("old", "new"):
        changes = changes.join(blobs.select(F.col("oid").alias(f"{side}_oid"), F.col("size").alias(f"_{side}")), f"{side}_oid", "left")
    none = lambda side: F.col(f"{side}_mode").isin(NO_FILE, MODULE)
    sizes = [F.when(none(s), 0).otherwise(F.col(f"_{s}")).cast("bigint").alias(f"{s}_size") for s in ("old", "new")]
    missing = (~none("old") & F.col("_old").isNull()) | (~none("new") & F.col("_new").isNull())
    return changes.select("*", *sizes, missing.alias("missing")).drop("_old", "_new")


def file_flags(path: Column, old_mode: Column, new_mode: Column, binary: Column, settings) -> Column:
    """(is_test, is_generated, excluded, eligible, area) of a file under ``settings``: whether its text is analysed follows from its path, modes and kind."""
    generated = matches_any(path, [*settings.generated, *(g for _, outputs in settings.generated_from for g in outputs)])
    excluded = (~matches_any(path, list(settings.include)) if settings.include else F.lit(False)) | matches_any(path, list(settings.exclude))
    special = old_mode.isin(LINK, MODULE) | new_mode.isin(LINK, MODULE)
    eligible = path.rlike(SOURCE) & ~excluded & ~generated & ~special & ~binary
    area = first_area(path, list(settings.areas)) if settings.areas else F.lit(None).cast("string")
    return F.struct(matches_any(path, list(settings.tests)).alias("is_test"), generated.alias("is_generated"), excluded.alias("excluded"), eligible.alias("eligible"), area.alias("area"))


def file_warnings(files: DataFrame) -> DataFrame:
    """Distinct (cs_id, type, path) about files (cs_id, path, excluded, eligible, readable) whose text isn't analysed: left out by settings, or not to be read."""
    kind = F.when(F.col("excluded"), "excluded-opaque").when(F.col("eligible") & ~F.col("readable"), "opaque-source")
    return files.select("cs_id", kind.alias("type"), "path").where("type IS NOT NULL").distinct()


def merged_maps(*maps: Column) -> Column:
    """One map of all keys; of equal keys the last map's value counts. Null maps count as empty."""
    entries = F.concat(*[F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>")) for m in maps])
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)
