"""Token ids in a content-addressed store: chunks once each, recipes per document, Merkle roots.

A text's id stream (its tokenizer ids, then one end id) is cut where a rolling hash over the last eight ids
meets a mask, so an edit moves only the cuts near it and copies share chunks. A store is a folder of two
Parquet tables:

* ``chunks``: digest (16 bytes, BLAKE2b of 0x00 and the ids as little-endian uint32), n, ids (the same ids as
  little-endian uint16, or uint32 where the vocabulary needs it, as ``width`` says). Each digest once.
* ``recipes``: doc_id, start (ids of all documents before it), n_tokens, digests (its chunks in order), root
  (Merkle root: pairs of digests hashed after 0x01, an odd one carried up), in ascending doc_id order.

Reading back checks each chunk's bytes against its digest and each recipe against its root.

Cases: a null or empty text is the end id alone; texts are stored whole; repeated rows get a recipe each and
share chunks; rows without a doc_id come before all others, rows that share one in any order; other columns are ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm._batches import small_batches
from weft.llm._order import bucket_splits, running_start
from weft.llm._tokens import Encoded, batches, crc_before, tokenizer_path, vocabulary_size, word_ids
from weft.session import materialize, shared_path, table

WINDOW, MEAN_IDS, MIN_IDS, MAX_IDS = 8, 512, 64, 4096


def cut_marks(flat: np.ndarray, mean: int = MEAN_IDS) -> np.ndarray:
    """Where the rolling hash over the last ``WINDOW`` ids of a run of streams meets the mask, as counts of ids before.

    Windows that reach into the stream before lie below ``MIN_IDS`` and are never used. ``mean`` is a power of two.
    """
    x = (flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    h = np.zeros(len(flat), np.uint64)
    for k in range(min(WINDOW, len(flat))):
        h[k:] += x[: len(flat) - k] * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
    return np.flatnonzero((h >> np.uint64(40)) & np.uint64(mean - 1) == 0) + 1


def cuts(n: int, marks: list[int], least: int = MIN_IDS, most: int = MAX_IDS) -> list[int]:
    """Ends of the chunks of a stream of ``n`` ids with these marks."""
    ends, last = [], 0
    for m in marks:
        while m - last > most:
            last += most
            ends.append(last)
        if m - last >= least:
            ends.append(m)
            last = m
    while n - last > most:
        last += most
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def leaf(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(b"\0" + ids.astype("<u4", copy=False).tobytes(), digest_size=16).digest()


def merkle_root(digests: list[bytes]) -> bytes:
    level = [bytes(d) for d in digests]
    while len(level) > 1:
        up = [hashlib.blake2b(b"\1" + a + b, digest_size=16).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = up + level[len(up) * 2 :]
    return level[0]


def _lists(rows: list[list[bytes]]) -> pa.Array:
    """An Arrow column of lists of bytes."""
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array([x for r in rows for x in r], pa.binary()))


def _encode(path: str, text: str, end_id: int, width: int):
    stored, end = f"<u{width}", np.array([end_id], np.int32)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in parts:
            texts = batch[text].to_pylist()
            for at, to in batches(texts):
                sizes, digests, chunks, roots = [], [], [], []
                e = Encoded(words, texts[at:to])
                bounds = e.upto[e.edges]
                marks = cut_marks(e.flat)
                own = np.searchsorted(marks, bounds, "right")
                for i in range(to - at):
                    a, b = bounds[i], bounds[i + 1]
                    ids = np.concatenate([e.flat[a:b], end])
                    ends = cuts(len(ids), (marks[own[i] : own[i + 1]] - a).tolist())
                    parts_of = [ids[p:q] for p, q in zip([0, *ends[:-1]], ends, strict=True)]
                    sizes.append(len(ids))
                    digests.append([leaf(c) for c in parts_of])
                    chunks.append([c.astype(stored).tobytes() for c in parts_of])
                    roots.append(merkle_root(digests[-1]))
                kept = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays(
                    [kept["doc_id"], kept["_tie"], pa.array(sizes, pa.int64()), _lists(digests), _lists(chunks), pa.array(roots, pa.binary())],
                    ["doc_id", "_tie", "n_tokens", "digests", "chunks", "root"],
                )

    return run


def write_store(docs: DataFrame, path: str, text: str = "text", tokenizer: str | None = None, end_id: int = 2, width: int = 2) -> None:
    """Write the ids of all ``docs`` as a store in folder ``path``. ``width``: bytes of a stored id, 2 up to 65,536 ids."""
    tokenizer = tokenizer or tokenizer_path()
    if width == 2 and max(end_id, vocabulary_size(tokenizer) - 1) >= 1 << 16:
        raise ValueError("this vocabulary needs a width of 4")
    rows = small_batches(docs).select("doc_id", text, F.xxhash64(text, F.monotonically_increasing_id()).alias("_tie"))  # written with the ids, so a row keeps its own
    cut = rows.mapInArrow(
        _encode(tokenizer, text, end_id, width),
        "doc_id bigint, _tie bigint, n_tokens bigint, digests array<binary>, chunks array<binary>, root binary",
    )
    cut = materialize(cut, "ids")
    chunks = cut.select(F.explode(F.arrays_zip("digests", "chunks")).alias("c")).select(F.col("c.digests").alias("digest"), F.col("c.chunks").alias("ids"))
    unique = chunks.groupBy("digest").agg(F.first("ids").alias("ids"))
    unique.select("digest", (F.octet_length("ids") / width).cast("int").alias("n"), "ids", F.lit(width).alias("width")).write.option("compression", "zstd").parquet(f"{path}/chunks")
    sizes = cut.select("doc_id", "_tie", "n_tokens", "digests", "root")
    placed = running_start(sizes, "n_tokens", bucket_splits(sizes))
    placed.select("doc_id", "start", "n_tokens", "digests", "root").repartitionByRange("start").sortWithinPartitions("start").write.parquet(f"{path}/recipes")


def _checked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        crc = []
        for digest, raw, width in zip(batch["digest"].to_pylist(), batch["ids"].to_pylist(), batch["width"].to_pylist(), strict=True):
            ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
            if leaf(ids) != digest:
                raise ValueError(f"chunk {digest.hex()} does not match its digest")
            crc.append(zlib.crc32(ids))
        yield pa.RecordBatch.from_arrays([batch["digest"], batch["n"], pa.array(crc, pa.int64())], ["digest", "n", "crc"])


def _put_together(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each recipe against its chunks' digests and sizes; its checksum from theirs."""
    for batch in parts:
        chunks = batch["parts"].flatten()
        upto = batch["parts"].offsets.to_numpy() - batch["parts"].offsets[0].as_py()
        if chunks.field("n").null_count:
            raise ValueError("a recipe names a chunk that is not in the store")
        n = chunks.field("n").to_numpy().astype(np.int64)
        digests = chunks.field("digest").to_pylist()
        total = np.concatenate([[0], np.cumsum(n)])
        doc = np.repeat(np.arange(len(batch)), np.diff(upto))
        after = total[upto[1:]][doc] - total[1:]
        crc = np.bitwise_xor.reduceat(crc_before(chunks.field("crc").to_numpy(), 4 * after), upto[:-1]) if len(n) else np.zeros(0, np.uint32)
        whole = total[upto[1:]] - total[upto[:-1]] == batch["n_tokens"].to_numpy()
        for i, root in enumerate(batch["root"].to_pylist()):
            if not whole[i] or merkle_root(digests[upto[i] : upto[i + 1]]) != root:
                raise ValueError("a document does not match its recipe")
        kept = [batch[c] for c in ("doc_id", "start", "n_tokens")]
        roots = pa.array([r.hex() for r in batch["root"].to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*kept, pa.array(crc.astype(np.int64)), pa.array(np.diff(upto).astype(np.int32)), roots], ["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", "merkle_root"])


def verify_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, n_chunks, merkle_root. Fails on any mismatch.

    Chunks are read once each and checked; only their checksums are joined to the recipes, so a
    document's checksum is put together without moving its ids.
    """
    chunks = spark.read.parquet(f"{path}/chunks").mapInArrow(_checked, "digest binary, n int, crc bigint")
    recipes = spark.read.parquet(f"{path}/recipes")
    parts = recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode("digests").alias("pos", "digest"))
    # (doc_id, start) names a row: every document has one id at least
    whole = parts.join(chunks, "digest", "left").groupBy("doc_id", "start", "n_tokens", "root").agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "n", "crc"))).alias("parts")
    )
    return small_batches(whole).mapInArrow(_put_together, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, n_chunks int, merkle_root string")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and the ids (array<int>) of every document, put together from the store."""
    chunks = spark.read.parquet(f"{path}/chunks")
    parts = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", F.posexplode("digests").alias("pos", "digest"))
    whole = parts.join(chunks, "digest").groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "ids", "width"))).alias("parts"))

    def joined(lists: pd.Series) -> pd.Series:
        return pd.Series([np.concatenate([np.frombuffer(p["ids"], f"<u{p['width']}").astype(np.int32) for p in ps]) for ps in lists], dtype=object)

    return whole.select("doc_id", "start", F.pandas_udf(joined, "array<int>")("parts").alias("ids"))


def op5_token_store(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "store")
    write_store(table(spark, sf_dir, "documents"), path)
    return verify_store(spark, path)
