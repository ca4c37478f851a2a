"""Objects in files: round trip, writers that meet, failing tasks, and damage."""

import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F

from weft.sources import objects


def _oid(type_, content, digest="sha1"):
    return hashlib.new(digest, b"%s %d\0" % (type_.encode(), len(content)) + content).hexdigest()


def _files(folder):
    return sorted(os.path.relpath(os.path.join(d, n), folder) for d, _, names in os.walk(folder) for n in names)


@pytest.mark.parametrize("digest", ["sha1", "sha256"])
def test_round_trip_and_meeting_writers(spark, tmp_path, digest):
    given = [("blob", b""), ("blob", b"a\0b"), ("tree", b"a\0b"), ("blob", b"a\0b"), ("commit", b"x" * 100000)]
    rows = spark.createDataFrame(given, "type string, content binary").repartition(3)
    folder = str(tmp_path)
    objects.write_objects(rows, folder, digest)
    want = {(_oid(t, c, digest), t, c) for t, c in given}
    assert {(r.oid, r.type, bytes(r.content)) for r in objects.read_objects(spark, folder).collect()} == want
    before = {f: os.stat(os.path.join(folder, f)).st_mtime_ns for f in _files(folder)}
    assert set(before) == {f"{o[:2]}/{o[2:]}" for o, _, _ in want}  # nothing unfinished stays
    objects.write_objects(rows.union(spark.createDataFrame([("tag", b"n")], rows.schema)), folder, digest)
    after = {f: os.stat(os.path.join(folder, f)).st_mtime_ns for f in _files(folder)}
    assert len(after) == len(before) + 1 and before.items() <= after.items()
    objects.write_objects(rows.limit(0), folder, digest)
    assert objects.read_objects(spark, folder).count() == 5


def test_failing_task_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path)
    for bad in (("other", b"x"), (None, b"x"), ("blob", None)):
        rows = spark.createDataFrame([("blob", b"%d" % i) for i in range(20)] + [bad], "type string, content binary")
        with pytest.raises(Exception):
            objects.write_objects(rows.coalesce(1), folder)
    rows = spark.range(0, 20, 1, 1).select(F.lit("blob").alias("type"), F.when(F.col("id") == 19, F.raise_error(F.lit("late"))).otherwise(F.col("id").cast("string")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="late"):
        objects.write_objects(rows, folder)
    assert os.listdir(folder) == [] and objects.read_objects(spark, folder).count() == 0
    with pytest.raises(Exception, match="never replaced"):
        rows.limit(1).withColumn("oid", F.lit("")).select("oid", "type", "content").write.format("objects").mode("overwrite").save(folder)


def test_damage_is_found(spark, tmp_path):
    rows = spark.createDataFrame([("blob", b"abc")], "type string, content binary")
    oid = _oid("blob", b"abc")
    whole = zlib.compress(b"blob 3\0abc")
    place = tmp_path / oid[:2]
    place.mkdir()
    for wrong in (b"", whole[:-2], whole + b"x", zlib.compress(b"blob 3\0abd"), zlib.compress(b"blob 4\0abc"), zlib.compress(b"abc")):
        (place / oid[2:]).write_bytes(wrong)
        with pytest.raises(ValueError):
            objects.read_object(str(place / oid[2:]), oid)
    with pytest.raises(Exception, match=oid):  # what is there isn't replaced, and isn't taken for the object
        objects.write_objects(rows, str(tmp_path))
    with pytest.raises(Exception, match=oid):
        objects.read_objects(spark, str(tmp_path)).collect()
    assert _files(str(tmp_path)) == [f"{oid[:2]}/{oid[2:]}"]
