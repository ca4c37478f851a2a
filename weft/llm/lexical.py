"""Ranked lexical search: the documents that fit each item best, by the terms they share.

Terms are runs of letters, digits and characters beyond ASCII, A-Z taken as a-z. All documents are read once: each becomes its number of terms and
the counts of those terms that some item has (a bag). From the bags come the corpus' figures, then classes of documents with equal bags
and equal length figure m, which all score the same. Spark groups them by a hash and by the bags' own bytes, so equal hashes of unequal bags
stay apart, and keeps of each class the ``k`` smallest doc_ids, as no item can list more. A class is scored once for all items of a block, as a
product of two matrices of whole numbers; a task passes on ``k`` documents an item, and a window over those picks the best.

Items are worked on in blocks of bounded size, each against all documents, so what is sent to workers has a bound however many items there are.

Cases: a document or item that is null or has no term takes part in nothing, but for the corpus' figures; documents whose bag is empty score
0 and are never listed; repeated rows are documents, or items, of their own; null doc_ids come first among equal scores; texts are
taken whole; other columns are ignored; no documents or no items give an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm import _words
from weft.llm._batches import small_batches
from weft.session import materialize, table

#: How terms are weighed.
SCALE, LENGTH, SHARE, TF_SCALE, SLOPE = 1000, 100, 50, 10**9, 20
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Bounds of a block: entries of its (term, item) matrix, bytes of its items' texts (one item at least); and of a worker's matrix of classes.
BLOCK_ENTRIES, BLOCK_BYTES, CHUNK_ENTRIES = 1 << 22, 4 << 20, 1 << 22

_U = np.uint64
_IS_TERM = np.ones(256, bool)
_IS_TERM[:128] = [chr(i).isalnum() for i in range(128)]
_DRAWN = _words.mix(np.arange(_words.PLACES * 256, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(0x632BE59BD9B4E019)).reshape(_words.PLACES, 256)
_DRAWN[:, ~_IS_TERM] = 0
_DRAWN = _DRAWN.ravel()


def terms_of(text: str | None) -> list[str]:
    return [t.translate(_LOWER) for t in re.findall(TERM, text or "")]


_LOWER = {c: c + 32 for c in range(65, 91)}


def _hashed(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins, ends and hashes of all terms in these bytes."""
    found = [_window(raw[a:b], a) for a, b in _words._windows(raw, _words.WINDOW)]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, _U)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _window(raw: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    term = np.zeros(len(raw) + 2, bool)
    term[1:-1] = _IS_TERM[raw]
    starts, ends = np.flatnonzero(term[1:-1] & ~term[:-2]), np.flatnonzero(term[1:-1] & ~term[2:]) + 1
    if not len(starts):
        return starts, ends, np.zeros(0, _U)
    low = _words.LOWER[raw[starts[0] :]]
    place = np.arange(len(low), dtype=np.int32)
    place -= np.repeat((starts - starts[0]).astype(np.int32), np.diff(starts, append=len(raw)))
    place &= _words.PLACES - 1
    place <<= 8
    place |= low
    keys = np.add.reduceat(_DRAWN[place], starts - starts[0])
    for i in np.flatnonzero(ends - starts > _words.PLACES).tolist():
        keys[i] = xxhash.xxh64_intdigest(low[starts[i] - starts[0] : ends[i] - starts[0]].tobytes())
    return starts + at, ends + at, keys


class Vocabulary:
    """Terms by number, found by hash and compared byte by byte."""

    def __init__(self, terms: list[str]) -> None:
        raw, _ = _words.joined(terms)
        self.starts, ends, keys = _hashed(raw)
        self.sizes, self.raw = ends - self.starts, raw
        self.numbers = _words.Numbers()
        self.numbers.add(keys)

    def __len__(self) -> int:
        return len(self.starts)

    def find(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The number of each of these terms, -1 for one that isn't known."""
        out = self.numbers.find(keys)
        known = np.flatnonzero(out >= 0)
        known = known[(ends - starts)[known] == self.sizes[out[known]]]
        sizes = self.sizes[out[known]]
        edges = np.cumsum(sizes) - sizes
        step = np.arange(int(sizes.sum())) - np.repeat(edges, sizes)
        other = _words.LOWER[raw[np.repeat(starts[known], sizes) + step]] != self.raw[np.repeat(self.starts[out[known]], sizes) + step]
        known = known[~np.logical_or.reduceat(other, edges)] if len(known) else known
        found = np.full(len(out), -1, np.int64)
        found[known] = out[known]
        return found


class _Block:
    """Some items: their rows' ids, all their terms and which item has which."""

    def __init__(self) -> None:
        self.ids, self.terms, self.pairs, self.bytes = [], {}, [], 0

    def add(self, item_id, terms: list[str], size: int) -> None:
        for t in dict.fromkeys(terms):
            self.pairs.append((self.terms.setdefault(t, len(self.terms)), len(self.ids)))
        self.ids.append(item_id)
        self.bytes += size

    def full(self) -> bool:
        return (len(self.ids) + 1) * len(self.terms) > BLOCK_ENTRIES or self.bytes > BLOCK_BYTES


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[_Block]:
    """Items with a term, in blocks; the driver holds one block at a time."""
    block = _Block()
    for key, content in items.select(item_id, text).toLocalIterator():
        if terms := terms_of(content):
            block.add(key, terms, len(content))
            if block.full():
                yield block
                block = _Block()
    if block.ids:
        yield block


def bags(docs: DataFrame, words: Vocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (terms of the text) and bag of each row: the vocabulary's terms in it, ascending, then how often each occurs (little-endian uint32)."""
    rows = small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, first = _words.joined(batch.column("text").to_pylist())
            starts, ends, keys = _hashed(raw)
            number = words.find(raw, starts, ends, keys)
            doc = np.searchsorted(first, starts, "right") - 1
            n = np.bincount(doc, minlength=batch.num_rows)
            pair, times = np.unique((doc * len(words) + number)[number >= 0], return_counts=True)
            edges = np.searchsorted(pair, np.arange(batch.num_rows + 1) * len(words))
            term, times = (pair % len(words)).astype("<u4"), times.astype("<u4")
            own = [term[a:b].tobytes() + times[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(own, pa.binary())], ["doc_id", "n", "bag"])

    return rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n bigint, bag binary")


def _pairs(bag: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of all entries of these bags."""
    own = [np.frombuffer(b, "<u4") for b in bag.to_pylist()]
    sizes = [len(x) // 2 for x in own]
    none = [np.zeros(0, np.int64)]
    return np.repeat(np.arange(len(own)), sizes), np.concatenate([*none, *(x[:s] for x, s in zip(own, sizes, strict=True))]), np.concatenate([*none, *(x[s:] for x, s in zip(own, sizes, strict=True))])


def _figures(known: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each term: a row a term and task is summed by Spark."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            n = batch.column("n").to_numpy()
            total[:n_terms] += np.bincount(_pairs(batch.column("bag"))[1], minlength=n_terms)
            total[n_terms:] += (int((n > 0).sum()), int(n.sum()))
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(total[term])], ["term", "n"])

    found = known.select("n", "bag").mapInArrow(tally, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a term of the block
    out = np.zeros(n_terms + 2, np.int64)
    for term, n in found:
        out[term] = n
    return int(out[n_terms]), int(out[n_terms + 1]), out[:n_terms]


def bag_classes(known: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """bag, m and docs (the k smallest doc_ids) of each class of documents with the same bag and m."""
    rows = known.where(F.length("bag") > 0).select("doc_id", "bag", F.expr(f"{LENGTH - SHARE} + ({SHARE} * n * {n_docs}L) div {max(1, n_terms)}L").alias("m"))
    keys = ["hash", "m", "bag"]
    hashed = rows.withColumn("hash", F.xxhash64("bag", "m"))
    least = hashed.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("doc_id").asc_nulls_first()))).where(F.col("place") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("doc_id"))).alias("docs")).drop("hash")


class _Best:
    """The k best (score, doc_id) of one item."""

    def __init__(self, k: int) -> None:
        self.k, self.rows, self.least = k, [], 1

    def add(self, scores: np.ndarray, docs: list[list]) -> None:
        at = np.flatnonzero(scores >= self.least)
        if len(at) > self.k:  # of classes, too, only the k best and their equals can be listed
            at = at[scores[at] >= np.partition(scores[at], -self.k)[-self.k]]
        for i in at.tolist():
            self.rows += [(int(scores[i]), d["doc_id"]) for d in docs[i]]
        if len(self.rows) > 4 * self.k:
            self.cut()

    def cut(self) -> list[tuple]:
        self.rows = sorted(self.rows, key=lambda r: (-r[0], r[1] is not None, r[1]))[: self.k]
        if len(self.rows) == self.k:
            self.least = self.rows[-1][0]
        return self.rows


def _scored(classes: DataFrame, pairs: list[tuple[int, int]], n_items: int, weights: np.ndarray, k: int) -> DataFrame:
    """item (its number), score and doc_id: each task's k best."""
    kind = classes.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    n_terms = len(weights)
    exact = int(weights.max(initial=0)) * (TF_SCALE // SCALE) * max(np.bincount([j for _, j in pairs])) < 1 << 53  # sums of doubles are then whole numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.float64 if exact else np.int64
        has = np.zeros((n_terms, n_items), number)
        has[tuple(np.array(pairs).T)] = 1
        best, out, step = [_Best(k) for _ in range(n_items)], None, max(1, CHUNK_ENTRIES // n_terms)
        for batch in batches:
            out = batch.schema.field("docs").type.value_type.field("doc_id").type
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                row, term, times = _pairs(part.column("bag"))
                times, m = times.astype(np.int64), part.column("m").to_numpy()[row]
                worth = np.zeros((part.num_rows, n_terms), number)
                worth[row, term] = weights[term] * (TF_SCALE * times // (SCALE * times + SLOPE * m))
                scores, docs = (worth @ has).astype(np.int64), part.column("docs").to_pylist()
                for j in range(n_items):
                    best[j].add(scores[:, j], docs)
        if out is not None:
            rows = [(j, s, d) for j in range(n_items) for s, d in best[j].cut()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), out))], ["item", "score", "doc_id"])

    return classes.mapInArrow(score, f"item int, score bigint, doc_id {kind}")


def _block_ranks(docs: DataFrame, block: _Block, kind: str, k: int, doc_id: str, text: str) -> DataFrame:
    words = Vocabulary(list(block.terms))
    known = materialize(bags(docs, words, doc_id, text), "bags")
    n_docs, n_terms, holders = _figures(known, len(words))
    weights = np.array([math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in holders.tolist()], np.int64)
    found = _scored(bag_classes(known, n_docs, n_terms, k), block.pairs, len(block.ids), weights, k)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = docs.sparkSession.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {kind}")
    return top.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k highest-scoring documents of each item, scores above 0 only."""
    kind, of = items.schema[item_id].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString()
    out = None
    for block in _blocks(items, item_id, item_text):
        found = _block_ranks(docs, block, kind, k, doc_id, text)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id {of}, score bigint") if out is None else out


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 50 documents that fit each benchmark item best."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS terms FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}'))) AS term FROM benchmark),
corpus AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY ALL),
held AS (SELECT term, floor({SCALE} * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus WHERE term IN (SELECT term FROM i) GROUP BY term, docs),
m AS (SELECT row, doc_id, {LENGTH - SHARE} + ({SHARE} * len(terms) * docs) // total AS m FROM d, corpus WHERE len(terms) > 0),
scored AS (
  SELECT item, item_id, row, doc_id, sum(w * (({TF_SCALE} * tf) // ({SCALE} * tf + {SLOPE} * m)))::BIGINT AS score
  FROM i JOIN held USING (term) JOIN tf USING (term) JOIN m USING (row) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 50
"""
