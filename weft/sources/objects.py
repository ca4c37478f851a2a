"""Sink and source of content-addressed objects in a folder that all executors mount: one compressed file an object, named by its id.

``write_objects`` takes (type, content): a task first writes all of its objects below a folder of its own, reads them back and checks their ids, and then links each
to its place. A link never replaces a file, so writers may meet: what is there already is read and must hold the same. A task that fails before its
last row has linked nothing; whatever becomes of the job, its folder of unfinished objects goes. Tasks that had ended by then leave whole objects that nothing names.
Every row of an id holds the same bytes, so a task that Spark runs twice does no harm. Each object is held by one task at a time; larger ones than MAX_BYTES are refused.
"""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Types and head of an object, as Git stores them, and the largest one.
TYPES = ("blob", "tree", "commit", "tag")
HEAD = re.compile(rb"(blob|tree|commit|tag) (0|[1-9][0-9]*)\0")
MAX_BYTES = 256 << 20
DIGESTS = {40: "sha1", 64: "sha256"}
SCHEMA = "oid string, type string, content binary"


def _whole(type_: str, content: bytes) -> bytes:
    if type_ not in TYPES:
        raise ValueError(f"unknown type of an object: {type_}")
    if content is None or len(content) > MAX_BYTES:
        raise ValueError("an object without content" if content is None else f"an object of {len(content)} bytes is over the limit of {MAX_BYTES}")
    return b"%s %d\0" % (type_.encode(), len(content)) + content


def read_object(path: str, oid: str) -> tuple[str, bytes]:
    """(type, content) of the file of an object; an error where it isn't what its id says."""
    if os.path.islink(path) or not os.path.isfile(path):
        raise ValueError(f"not a regular file: {path}")
    with open(path, "rb") as file:
        inflate = zlib.decompressobj()
        try:
            raw = inflate.decompress(file.read(), MAX_BYTES + 64)
        except zlib.error as error:
            raise ValueError(f"object {oid}: {error}") from None
    head = HEAD.match(raw)
    if not head or not inflate.eof or inflate.unused_data or int(head[2]) != len(raw) - head.end() or hashlib.new(DIGESTS[len(oid)], raw).hexdigest() != oid:
        raise ValueError(f"not the object of its id: {oid}")
    return head[1].decode(), raw[head.end() :]


@dataclass
class _Done(WriterCommitMessage):
    objects: int


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.folder, self.digest = options["path"].removeprefix("file:"), options.get("digest", "sha1")
        if self.digest not in DIGESTS.values():
            raise ValueError(f"unknown digest: {self.digest}")
        self.stage = os.path.join(self.folder, f"tmp_{uuid.uuid4().hex}")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        own = os.path.join(self.stage, uuid.uuid4().hex)
        os.makedirs(own)
        staged = set()
        try:
            for row in rows:
                raw = _whole(row["type"], row["content"])
                oid = hashlib.new(self.digest, raw).hexdigest()
                if oid in staged:
                    continue
                path = os.path.join(own, oid)
                with open(path, "wb") as file:
                    file.write(zlib.compress(raw))
                    file.flush()
                    os.fsync(file.fileno())
                read_object(path, oid)
                staged.add(oid)
            for oid in sorted(staged):
                place = os.path.join(self.folder, oid[:2])
                os.makedirs(place, exist_ok=True)
                try:
                    os.link(os.path.join(own, oid), os.path.join(place, oid[2:]))
                except FileExistsError:
                    read_object(os.path.join(place, oid[2:]), oid)
        finally:
            shutil.rmtree(own)
        return _Done(len(staged))

    def commit(self, messages) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


@dataclass
class _Ids(InputPartition):
    folders: list[str]
    start: str


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"].removeprefix("file:")

    def partitions(self) -> list[InputPartition]:
        """One for all ids that begin alike: in 1, 2 or 3 digits, by how many objects there are. Ids are spread evenly, so that one folder tells."""
        found = sorted(n for n in os.listdir(self.folder) if re.fullmatch("[0-9a-f]{2}", n))
        about = len(found) * len(os.listdir(os.path.join(self.folder, found[0]))) if found else 0
        digits = 1 if about < 1 << 14 else 2 if about < 1 << 20 else 3
        starts = (f"{i:0{digits}x}" for i in range(16**digits))
        return [p for p in (_Ids([n for n in found if n.startswith(s[:2])], s) for s in starts) if p.folders] or [_Ids([], "")]

    def read(self, part: _Ids) -> Iterator[tuple]:
        for folder in part.folders:
            for name in os.listdir(os.path.join(self.folder, folder)):
                oid = folder + name
                if len(oid) not in DIGESTS or not re.fullmatch("[0-9a-f]+", name):
                    raise ValueError(f"not the name of an object: {folder}/{name}")
                if oid.startswith(part.start):
                    yield oid, *read_object(os.path.join(self.folder, folder, name), oid)


class Objects(DataSource):
    """Options: path, and digest (sha1 or sha256) for writing."""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("objects are never replaced: write with mode append")
        return _Writer(self.options)


def write_objects(rows: DataFrame, folder: str, digest: str = "sha1") -> None:
    """Add the objects of ``rows`` (type, content) to a folder. Equal rows meet in one task by their digests, and so are written once."""
    rows.sparkSession.dataSource.register(Objects)
    once = rows.select("type", F.col("content").cast("binary").alias("content")).withColumn("_d", F.sha2("content", 256)).dropDuplicates(["type", "_d"])
    once.select(F.lit(None).cast("string").alias("oid"), "type", "content").write.format("objects").option("digest", digest).mode("append").save(folder)


def read_objects(spark: SparkSession, folder: str) -> DataFrame:
    """(oid, type, content) of all objects of a folder, each checked against its id."""
    spark.dataSource.register(Objects)
    return spark.read.format("objects").load(folder)
