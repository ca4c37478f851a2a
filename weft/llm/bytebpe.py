"""Byte-level BPE of whole texts: each distinct word is encoded once, and ids come back to texts through joins.

1. Texts are split into words, block by block (some million words of consecutive documents). A block's row has its distinct words once, the
   sequence of their numbers, and how many words each document has. Blocks are written once, dealt into buckets by their id.
2. The distinct words of all blocks are dealt and sorted by word: that is the word table, in which the tokenizers library encodes each word once.
3. Each word's ids go back to its blocks, many words a row, and are joined with them where their bucket is: sequences, most of the data, are never
   shuffled. Behind the join, ids are laid out by position.
4. Decoding takes the pieces of ids from the tokenizer's id-to-piece table, which has a row an id of the vocabulary and is sent to the workers.

Words are told apart by 64-bit hashes with their lengths inside a block, by their bytes in the joins. Added tokens of the file are words of their
own. A block ends at ``BLOCK_WORDS`` words or ``BLOCK_DISTINCT`` distinct ones, or behind one batch of texts that has more.

Cases: null and empty texts have no ids and decode to the empty text; texts are taken whole; repeated rows and null doc_ids give a row each; other
columns are ignored; an empty table gives none. Ids that make no valid UTF-8 decode with replacement characters.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import _bytes, _words
from weft.llm._batches import small_batches
from weft.llm._tokens import tokenizer_path
from weft.session import shared_path, table

BLOCK_WORDS, BLOCK_DISTINCT, PART, FLUSH = 6_000_000, 450_000, 1 << 20, 400_000


@lru_cache(maxsize=1)
def _splitter(path: str) -> _bytes.Splitter:
    """One for each Python worker: its tasks follow on one another."""
    return _bytes.Splitter(path)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers as four planes of bytes, of which the high ones are nearly empty; compressed where there are more than a few."""
    import zstandard

    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return b"\0" + planes if len(planes) < 256 else b"\1" + zstandard.compress(planes, 1)


def _planes(packed: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(packed[1:]) if packed[0] else packed[1:], np.uint8).reshape(4, -1)


def _unpacked(packed: bytes) -> np.ndarray:
    return _joined(_planes(packed))


def _joined(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class _Block:
    """Distinct words and their sequence, of the documents added so far."""

    def __init__(self) -> None:
        self.numbers = _words.Numbers()
        self.words: list[bytes] = []
        self.sequence: list[np.ndarray] = []
        self.ids, self.counts, self.size = [], [], 0

    def add(self, splitter: _bytes.Splitter, doc_ids: list, texts: list[str | None]) -> None:
        parts, owner = [], []
        for i, t in enumerate(texts):
            own = splitter.segments(t) if t else []
            parts += own
            owner += [i] * len(own)
        counts = np.zeros(len(texts), np.int64)
        at = 0
        while at < len(parts):  # some segments at a time: a long text is worked through in parts
            to, size = at, 0
            while to < len(parts) and (to == at or size + len(parts[to][0]) <= PART):
                size += len(parts[to][0])
                to += 1
            data, begin = splitter.split(parts[at:to])
            keys = _bytes.hashes(data, begin)
            found = self.numbers.find(keys)
            new = np.flatnonzero(found < 0)
            if len(new):
                own, first = np.unique(keys[new], return_index=True)
                self.numbers.add(own)
                raw = data.tobytes()
                self.words += [raw[a:b] for a, b in zip(begin[new[first]].tolist(), begin[new[first] + 1].tolist(), strict=True)]
                found[new] = self.numbers.find(keys[new])
            self.sequence.append(found.astype(np.int32))
            self.size += len(found)
            ends = np.cumsum([len(p.encode()) for p, _ in parts[at:to]])
            np.add.at(counts, owner[at:to], np.diff(np.searchsorted(begin[:-1], ends), prepend=0))
            at = to
        self.ids += doc_ids
        self.counts += counts.tolist()

    def row(self) -> tuple:
        flat = np.concatenate([np.zeros(0, np.int32), *self.sequence])
        # frequent words get small numbers, which pack best
        order = np.argsort(-np.bincount(flat, minlength=len(self.words)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        return [self.words[i] for i in order.tolist()], _packed(rank[flat]), self.ids, self.counts


def _blocks(docs: DataFrame, path: str, doc_id: str, text: str) -> DataFrame:
    """Blocks as a bucketed table in the shared folder: block, words, sequence, ids (doc_ids), counts (words of each)."""
    rows = small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, task, number, block, out = _splitter(path), TaskContext.get().partitionId(), 0, _Block(), None

        def written() -> pa.RecordBatch:
            words, sequence, ids, counts = block.row()
            types = (pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.list_(out), pa.list_(pa.int64()))
            own = ([(task << 32) + number], [words], [sequence], [ids], [counts])
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(own, types, strict=True)], ["block", "words", "sequence", "ids", "counts"])

        for batch in batches:
            out = batch.schema.field("doc_id").type
            block.add(splitter, batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
            if block.size >= BLOCK_WORDS or len(block.words) >= BLOCK_DISTINCT:
                yield written()
                number, block = number + 1, _Block()
        if block.ids:
            yield written()

    spark, name = docs.sparkSession, f"weft_blocks_{uuid.uuid4().hex}"
    found = rows.mapInArrow(split, f"block bigint, words array<binary>, sequence binary, ids array<{kind}>, counts array<bigint>")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found.write.bucketBy(buckets, "block").option("path", shared_path(spark, "blocks")).option("compression", "zstd").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and the plan above knows them
    return blocks


def _encoded(words: DataFrame, path: str) -> DataFrame:
    """Words (block, number, word), dealt and sorted by word, so that all places of a word meet: it is encoded once, and its ids go back to its blocks.

    Gives block, numbers, sizes and ids (packed), many words of a block a row.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, last, held = _splitter(path).tokenizer, (None, None), []

        def flushed() -> pa.RecordBatch:
            block, number, sizes, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(block, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(block[order]) != 0, [True]]))
            starts, rows = np.cumsum(sizes) - sizes, []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = order[a:b]
                rows.append((int(block[own[0]]), *map(_packed, (number[own], sizes[own], _taken(ids, starts, sizes, own)))))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), *[pa.binary()] * 3))], ["block", "numbers", "sizes", "ids"])

        waiting = 0
        for batch in batches:
            word = batch.column("word").dictionary_encode()
            every = word.dictionary.to_pylist()
            new = [w for w in every if w != last[0]]
            found = dict(zip(new, (np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)), strict=True))
            own = [found[w] if w != last[0] else last[1] for w in every]
            last = (every[-1], own[-1]) if every else last
            sizes, which = np.array([len(x) for x in own], np.int64), word.indices.to_numpy()
            flat = np.concatenate([np.zeros(0, "<u4"), *own])
            held.append((batch.column("block").to_numpy(), batch.column("number").to_numpy(), sizes[which], _taken(flat, np.cumsum(sizes) - sizes, sizes, which)))
            waiting += batch.num_rows
            if waiting >= FLUSH:
                yield flushed()
                held, waiting = [], 0
        if held:
            yield flushed()

    dealt = words.repartition("word").sortWithinPartitions("word")
    return dealt.mapInArrow(encode, "block bigint, numbers binary, sizes binary, ids binary")


def _flat(values: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all of these cells, one after another, and how many each has."""
    edges = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset)
    flat = np.frombuffer(values.buffers()[2], "<u4", int(edges[-1] - edges[0]) // 4, int(edges[0])) if edges[-1] > edges[0] else np.zeros(0, "<u4")
    return flat, np.diff(edges) // 4


def _taken(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches ``which`` of ``pool``, one after another."""
    own = sizes[which]
    ends = np.cumsum(own)
    return pool[np.repeat(starts[which] - (ends - own), own) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _ranges(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum up to ``most``, one at least."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def encode_documents(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (little-endian uint32) of each row of ``docs``."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    blocks = _blocks(docs, path, doc_id, text)
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    words = blocks.select("block", F.posexplode("words").alias("number", "word"))
    known = _encoded(words, path).groupBy("block").agg(F.collect_list(F.struct("numbers", "sizes", F.col("ids").alias("of"))).alias("known"))
    joined = blocks.drop("words").join(known, "block", "left")

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.schema.field("ids").type.value_type
            for i in range(batch.num_rows):
                own = batch.column("known").slice(i, 1).flatten()
                number, sizes, pool = (np.concatenate([np.zeros(0, "<u4"), *map(_unpacked, own.field(n).to_pylist())]) if len(own) else np.zeros(0, "<u4") for n in ("numbers", "sizes", "of"))
                sizes = sizes.astype(np.int64)
                starts = np.cumsum(sizes) - sizes
                place = np.empty(len(number), np.int32)
                place[number] = np.arange(len(number), dtype=np.int32)
                sequence = _planes(batch.column("sequence")[i].as_py())
                ids, counts = batch.column("ids")[i].values, batch.column("counts")[i].values.to_numpy()
                upto = np.concatenate([[0], np.cumsum(counts)])
                for a, b in _ranges(counts, PART // 4):
                    which = place[_joined(sequence[:, upto[a] : upto[b]])]
                    flat = _taken(pool, starts, sizes, which).tobytes()
                    ends = 4 * np.concatenate([[0], np.cumsum(sizes[which])])[upto[a : b + 1] - upto[a]]
                    cells = [flat[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).cast(out), pa.array(cells, pa.binary())], ["doc_id", "ids"])

    return joined.select("sequence", "ids", "counts", "known").mapInArrow(lay_out, f"doc_id {kind}, ids binary")


def pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The id-to-piece table: the bytes of all pieces in the order of their ids, and where each begins (then the end)."""
    tokenizer = _splitter(path).tokenizer
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # fixed: bytes that stand for themselves; the others follow from 256 on
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    found = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
    own = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in found]
    return np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)])


def decode_documents(encoded: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``encoded`` with the column ``decoded``: the text of its ids, special tokens included."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    pool, edges = pieces(path)
    others = [c for c in encoded.columns if c != "decoded"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, sizes = edges[:-1], np.diff(edges)
        for batch in batches:
            flat, counts = _flat(batch.column(ids))
            upto = np.concatenate([[0], np.cumsum(counts)])
            for a, b in _ranges(counts, PART // 2):
                which = flat[upto[a] : upto[b]].astype(np.int64)
                raw = _taken(pool, starts, sizes, which).tobytes()
                ends = np.concatenate([[0], np.cumsum(sizes[which])])[upto[a : b + 1] - upto[a]]
                texts = [raw[x:y].decode("utf-8", "replace") for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in others], pa.array(texts, pa.string())], [*others, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name in others)
    return encoded.select(*[F.col(f"`{c}`") for c in others]).mapInArrow(decode, f"{schema}, decoded string")


def op13_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    """Ids of every document and the text decoded from them, as digests."""
    decoded = decode_documents(encode_documents(table(spark, sf_dir, "documents")))
    return decoded.select("doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
