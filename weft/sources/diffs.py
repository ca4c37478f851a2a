"""Data source of diffs in files: the records of Git's raw and counting forms, with NUL behind each field, in splits of any size.

``spark.read.format("nul_diff").option("form", "raw" | "counts").load(folder)`` reads every file below ``folder``. A file's change-set is its folder's value where
that is named ``cs_id=...``, else its own name without the ending. One file may hold any number of records, a change-set any number of files.

A record is one field and the paths that follow it. A path may be any text, also one that looks like the first field of a record; so a split can't tell by its own
first bytes where a record begins. It reads back from its start with every number of paths that may still be due, until one number is left that fits
all fields in between (at the latest at the file's start), and then takes the records whose first field begins inside it.

A field that isn't what it must be, paths that aren't UTF-8, and a file that ends inside a record are errors that name the file and the byte. Empty files have no rows.
Options changeSets and statuses (lists with commas between) leave out files and rows before they are read or built. Filters aren't taken from Spark's optimizer: in
Spark 4.1 a source in Python that takes them keeps one query's filters for the next query on the same DataFrame, and then gives too few rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weft.functions.paths import is_safe

SPLIT_BYTES = 32 << 20
OPEN_COST = 64 << 10  # bytes that opening a file counts for where small files share a task
MAX_FIELD = 1 << 20  # bytes of one field; a longer one isn't a path of any file system
_READ, _LOOK_BACK, _ROWS = 1 << 20, 1 << 12, 8192

# The first fields of records, as Git writes them.
RAW_HEAD = re.compile(rb":([0-7]{6}) ([0-7]{6}) ([0-9a-f]+) ([0-9a-f]+) ([A-Z])([0-9]*)")
COUNTS_HEAD = re.compile(rb"([0-9]+|-)\t([0-9]+|-)\t(.*)", re.DOTALL)
SCHEMAS = {
    "raw": "cs_id string, pos bigint, old_mode string, new_mode string, old_oid string, new_oid string, status string, score int, old_path string, new_path string",
    "counts": "cs_id string, pos bigint, added bigint, deleted bigint, is_binary boolean, path string",
}


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _due(form: str, head: bytes) -> int | None:
    """How many paths follow a record's first field; None if it can't be one."""
    if form == "raw":
        m = RAW_HEAD.fullmatch(head)
        return m and (2 if m[5] in b"RC" else 1)
    m = COUNTS_HEAD.fullmatch(head)
    return m and (0 if m[3] else 2)


def _fields(file, start: int) -> Iterator[tuple[int, bytes]]:
    """(first byte, field) of each field that begins at ``start`` or behind it."""
    size, at, rest = file.size(), max(start - 1, 0), b""
    skip = start > 0  # what comes before the first NUL belongs to a field that began earlier
    while True:
        file.seek(at + len(rest))
        more = file.read(_READ)
        if not more:
            break
        *whole, tail = (rest + more).split(b"\0")
        for field in whole:
            if not skip:
                yield at, field
            skip, at = False, at + len(field) + 1
        rest = tail
        if len(rest) > MAX_FIELD:
            raise ValueError(f"malformed diff: no end of a field within {MAX_FIELD} bytes from byte {at}")
    if rest and not skip and at < size:
        raise ValueError(f"malformed diff: the file ends inside the field at byte {at}")


def _due_at(file, form: str, start: int) -> int:
    """How many paths are still due where the first field at or behind ``start`` begins."""
    back = _LOOK_BACK
    while True:
        base = max(start - back, 0)
        due, seen = ({0} if base == 0 else {0, 1, 2}), base == 0
        for at, field in _fields(file, base):
            seen = True
            if at >= start:
                break
            due = {_due(form, field) if n == 0 else (n - 1 if field else None) for n in due} - {None}
            if not due:
                raise ValueError(f"malformed diff: no record has the field at byte {at}")
        if seen and len(due) == 1:
            return due.pop()
        if base == 0:
            return 0
        back *= 8


def records(file, form: str, start: int, end: int) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """(first byte, first field, paths) of the records of a file whose first field begins in [start, end)."""
    ahead = _due_at(file, form, start) if start else 0  # paths of a record that began before
    head, left, found = None, 0, []
    for at, field in _fields(file, start):
        if ahead:
            ahead -= 1
            continue
        if left == 0:
            if at >= end:
                return
            due = _due(form, field)
            if due is None:
                raise ValueError(f"malformed diff: no record begins with the field at byte {at}")
            head, left, found = (at, field), due, []
        elif not field:
            raise ValueError(f"malformed diff: empty path at byte {at}")
        else:
            found.append(field)
            left -= 1
        if left == 0:
            yield *head, found
    if left:
        raise ValueError(f"malformed diff: the file ends inside the record at byte {head[0]}")


def _path(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        raise ValueError(f"path isn't UTF-8: {raw!r}") from None


def _raw_row(head: bytes, found: list[bytes]) -> tuple:
    *ids, status, score = (x.decode() for x in RAW_HEAD.fullmatch(head).groups())
    first, last = _path(found[0]), _path(found[-1])
    return *ids, status, int(score) if score else None, None if status == "A" else first, None if status == "D" else last


def _counts_row(head: bytes, found: list[bytes]) -> tuple:
    added, deleted, own = COUNTS_HEAD.fullmatch(head).groups()
    number = lambda x: 0 if x == b"-" else int(x)
    return number(added), number(deleted), added == b"-", _path(found[-1] if found else own)


@dataclass
class Split:
    cs_id: str
    path: str
    start: int
    end: int


@dataclass
class Part(InputPartition):
    splits: list[Split]


def _change_set(path: str) -> str:
    folder, name = os.path.split(path)
    for part in reversed(folder.split("/")):
        if part.startswith("cs_id="):
            return part.removeprefix("cs_id=")
    return name.rsplit(".", 1)[0] if "." in name[1:] else name


class _Reader(DataSourceReader):
    def __init__(self, options, schema):  # names of options in any case
        self.form, self.folder = options.get("form", "raw"), options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        if self.split < 1:
            raise ValueError("splitBytes must be at least 1")
        self.change_sets, self.statuses = (set(options[k].split(",")) if options.get(k) else None for k in ("changeSets", "statuses"))
        self.schema = schema

    def partitions(self) -> list[InputPartition]:
        system, folder = _system(self.folder)
        parts, room = [], 0
        for info in sorted(system.get_file_info(fs.FileSelector(folder, recursive=True)), key=lambda i: i.path):
            hidden = any(p[:1] in "._" for p in info.path[len(folder) :].strip("/").split("/"))
            cs = _change_set(info.path)
            if info.type != fs.FileType.File or hidden or (self.change_sets is not None and cs not in self.change_sets):
                continue
            for at in range(0, info.size, self.split):
                split = Split(cs, info.path, at, min(at + self.split, info.size))
                cost = split.end - at + OPEN_COST
                if cost > room:
                    parts.append(Part([]))
                    room = self.split + OPEN_COST
                parts[-1].splits.append(split)
                room -= cost
        return parts or [Part([])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        system = _system(self.folder)[0]
        rows = []
        for split in part.splits:
            with system.open_input_file(split.path) as file:
                try:
                    for at, head, found in records(file, self.form, split.start, split.end):
                        if self.form == "counts":
                            rows.append((split.cs_id, at, *_counts_row(head, found)))
                        elif self.statuses is None or RAW_HEAD.fullmatch(head)[5].decode() in self.statuses:
                            rows.append((split.cs_id, at, *_raw_row(head, found)))
                        if len(rows) == _ROWS:
                            yield self._batch(rows)
                            rows = []
                except ValueError as error:
                    raise ValueError(f"{split.path}: {error}") from None
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        columns = zip(zip(*rows), self.schema.fields)
        return pa.RecordBatch.from_arrays([pa.array(c, types[f.dataType.simpleString()]) for c, f in columns], self.schema.names)


class NulDiffs(DataSource):
    """Options: form (raw or counts), splitBytes, changeSets, statuses (of the raw form)."""

    @classmethod
    def name(cls) -> str:
        return "nul_diff"

    def schema(self) -> str:
        form = self.options.get("form", "raw")
        if form not in SCHEMAS:
            raise ValueError(f"unknown form of a diff: {form}")
        return SCHEMAS[form]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, schema)


def read_diffs(spark: SparkSession, folder: str, form: str = "raw", split_bytes: int = SPLIT_BYTES, **options: str) -> DataFrame:
    """The records below ``folder``."""
    spark.dataSource.register(NulDiffs)
    return spark.read.format("nul_diff").options(form=form, splitBytes=split_bytes, **options).load(folder)


def read_changes(spark: SparkSession, raw: str, counts: str, split_bytes: int = SPLIT_BYTES, **options: str) -> DataFrame:
    """The rows of :func:`weft.operators.changes.raw_changes` from files, with safe: whether both paths may be written below a folder. Counts are 0 where there are none."""
    files = read_diffs(spark, raw, "raw", split_bytes, **options).withColumn("path", F.coalesce("new_path", "old_path"))
    sizes = read_diffs(spark, counts, "counts", split_bytes, **options).groupBy("cs_id", "path").agg(F.max_by("added", "pos").alias("added"), F.max_by("deleted", "pos").alias("deleted"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    own = lambda c: F.col(c).isNull() | is_safe(F.col(c))
    return files.join(sizes, ["cs_id", "path"], "left").select(
        "cs_id", "old_path", "new_path", "old_mode", "new_mode", "old_oid", "new_oid", "status", "score", zero("added"), zero("deleted"), (own("old_path") & own("new_path")).alias("safe")
    )
