"""Order-preserving packing: the best window cuts by dynamic programming with a monotone queue.

All documents' ids form one stream, in doc_id order or a given other one (the pipeline packs in the order of a hash, which
keeps the copies of a document and the documents of a source apart). A window of up to 4096 ids may end at a document end (free),
at a sentence end inside a document (a truncation penalty) or, inside a sentence of over 1024 ids, at every
1024th id (a larger one). A window of n ids costs 4096 - n in padding. With boundaries p and best costs f,

    f[j] = penalty[j] + 4096 - p[j] + min over p[i] >= p[j] - 4096 of (f[i] + p[i]),

a sliding minimum, which a monotone queue keeps in constant time per boundary. The stream is solved in
segments of about a million ids, each a task's worth: documents belong to the segment their first id is in, so a
segment is no longer than that plus one document, and each adds one part-filled window at most.

Only lengths and running checksums leave the tokenizing pass, never the ids.

Cases: a null or empty text is the end id alone; a text longer than a window is cut; repeated rows are packed
each, those that share a doc_id in any order; rows without a doc_id come first; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.llm._batches import small_batches
from weft.llm._order import bucket_splits, running_start
from weft.llm._tokens import Encoded, batches, crc_before, tokenizer_path, word_ids
from weft.session import materialize, table

WINDOW, FORCED_EVERY = 4096, 1024
SEGMENT_IDS = 1 << 20
SENTENCE_PENALTY, FORCED_PENALTY = 32, 256


def _measure(path: str, text: str, end_id: int, every: int):
    """Per text: its number of ids, the ends of its sentences in ids, which are forced, and the checksum up to each."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_ids(path)
        end = np.uint32(end_id).astype("<u4").tobytes()
        for pdf in parts:
            texts = pdf[text].tolist()
            for at, to in batches(texts):
                rows = []
                e = Encoded(words, texts[at:to])
                stop = words.ends_sentence[e.numbers]
                stop[e.line_ends[e.line_ends > 0] - 1] = True
                for i in range(to - at):
                    a, b = e.edges[i], e.edges[i + 1]
                    base = e.upto[a]
                    n = int(e.upto[b] - base) + 1
                    ends = np.unique(e.upto[a + 1 + np.flatnonzero(stop[a:b])] - base)
                    ends = np.append(ends[(ends > 0) & (ends < n - 1)], n)
                    gaps = np.diff(ends, prepend=0)
                    forced = np.zeros(len(ends), bool)
                    if gaps.max() > every:
                        more = [np.arange(x - g + every, x, every) for x, g in zip(ends, gaps, strict=True) if g > every]
                        more = np.concatenate(more)
                        order = np.argsort(np.concatenate([ends, more]), kind="stable")
                        forced = np.concatenate([forced, np.ones(len(more), bool)])[order]
                        ends = np.concatenate([ends, more])[order]
                    raw = memoryview(e.flat[base : base + n - 1].astype("<u4").tobytes() + end)
                    crc, last, crcs = 0, 0, []
                    for x in ends.tolist():
                        crc = zlib.crc32(raw[4 * last : 4 * x], crc)
                        crcs.append(crc)
                        last = x
                    rows.append((n, ends.astype(np.int32), forced, crcs))
                part = pdf.iloc[at:to]
                got = pd.DataFrame(rows, columns=["n_tokens", "ends", "forced", "crcs"], index=part.index)
                yield pd.concat([part[["doc_id", "_key", "_tie"]], got], axis=1)

    return run


def best_cuts(p: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """Indices of the boundaries at which windows end. ``p``: ascending boundaries after 0, no gap over ``window``."""
    at, cost = [0, *p.tolist()], [0, *penalty.tolist()]
    best, back = [0] * len(at), [0] * len(at)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f[i] + p[i], i), ascending in both
    for j in range(1, len(at)):
        x = at[j]
        while at[queue[0][1]] < x - window:
            queue.popleft()
        key, i = queue[0]
        best[j], back[j] = cost[j] + window - x + key, i
        key = best[j] + x
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], len(at) - 1
    while j > 0:
        out.append(j - 1)
        j = back[j]
    return out[::-1]


def _pack(window: int, sentence: int, forced_cost: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start", kind="stable")
        sizes = pdf["n_tokens"].to_numpy(np.int64)
        first = np.cumsum(sizes) - sizes
        counts = np.fromiter(map(len, pdf["ends"]), np.int64, len(pdf))
        doc = np.repeat(np.arange(len(pdf)), counts)
        ends = np.concatenate(pdf["ends"].to_list()).astype(np.int64)
        crcs = np.concatenate([np.asarray(c, np.int64) for c in pdf["crcs"]])
        forced = np.concatenate([np.asarray(f, bool) for f in pdf["forced"]])
        penalty = np.where(forced, forced_cost, sentence)
        penalty[np.cumsum(counts) - 1] = 0
        cut = best_cuts(first[doc] + ends, penalty, window)
        # pieces end at window ends and at document ends
        is_cut = np.zeros(len(doc), bool)
        is_cut[cut] = True
        piece = np.flatnonzero(is_cut | (ends == sizes[doc]))
        d, stop = doc[piece], ends[piece]
        prev = np.concatenate([[-1], piece[:-1]])
        same = np.concatenate([[False], d[1:] == d[:-1]])
        start = np.where(same, ends[prev], 0)
        seq = np.concatenate([[0], np.cumsum(is_cut[piece])[:-1]])
        length = stop - start
        total = np.cumsum(length) - length
        new = np.concatenate([[True], seq[1:] != seq[:-1]])
        offset = total - np.maximum.accumulate(np.where(new, total, 0))
        crc = crcs[piece] ^ np.where(start == 0, 0, crc_before(crcs[prev], 4 * length))  # the part before the piece taken off
        return pd.DataFrame({
            "doc_id": pdf["doc_id"].to_numpy()[d], "start": start, "length": length, "ids_crc32": crc,
            "doc_tokens": sizes[d], "sequence_id": (int(key[0]) << 24) + seq, "offset": offset,
        })

    return run


def shuffled(seed: str) -> Column:
    """An order of pack_documents in which equal rows lie anywhere, too: a hash of seed, doc_id, text and number of the copy."""
    return F.xxhash64(F.lit(seed), "doc_id", "_key", "_copy")


def pack_documents(docs: DataFrame, text: str = "text", tokenizer: str | None = None, end_id: int = 2, window: int = WINDOW, segment: int = SEGMENT_IDS, sentence_penalty: int = SENTENCE_PENALTY, forced_penalty: int = FORCED_PENALTY, order: Column | None = None) -> DataFrame:
    """One row for each piece of a document in a sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``order``: a bigint by which the documents are packed, from doc_id, _key (the text's hash) and _copy (from 1 over equal rows); doc_id if None.
    """
    rows = small_batches(docs).select("doc_id", text, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_key")).withColumn("_tie", F.xxhash64("_key", F.monotonically_increasing_id()))
    measured = rows.mapInPandas(
        _measure(tokenizer or tokenizer_path(), text, end_id, min(FORCED_EVERY, window)),
        "doc_id bigint, _key bigint, _tie bigint, n_tokens bigint, ends array<int>, forced array<boolean>, crcs array<bigint>",
    )
    by = "doc_id"
    if order is not None:
        by = "_order"
        copy = F.row_number().over(W.partitionBy("doc_id", "_key").orderBy("n_tokens"))  # equal rows: any order of them is the same
        measured = measured.withColumn("_copy", copy).withColumn(by, order)
    measured = materialize(measured, "lengths")
    placed = running_start(measured, "n_tokens", bucket_splits(measured, by), by)
    placed = placed.withColumn("segment", F.floor(F.col("start") / segment))
    return placed.select("segment", "doc_id", "start", "n_tokens", "ends", "forced", "crcs").groupBy("segment").applyInPandas(
        _pack(window, sentence_penalty, forced_penalty),
        "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    )


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
