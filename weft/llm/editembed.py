"""Document fingerprints by randomised edit embedding.

All texts share one random walk: at step j the character x under the cursor is emitted and the cursor moves
on if a bit drawn for (j, x) is one. Two texts that agree up to an edit fall back into step after it, so
their emitted strings differ in about as many places as edits separate them. The walk runs until the whole text
is read. The fingerprint keeps 64 sampled places of each power-of-two stretch of the walk, as one hex
digit (four bits hashed from the character) each, so texts of any length compare: a stretch counts by its length.
Places past the end of a text hold a digit for the end.

Walks of a batch of texts advance together in numpy, one step of all texts that still read at a time.
Near documents: sampled digits are banded, equal bands make candidates, and candidates are verified by likeness.

Cases: a null text is empty, and the fingerprint of an empty text is one digit; texts are read whole; equal texts
have equal fingerprints, repeated rows too; rows without a doc_id come first in the order that gives the next document;
a table of one row is its own next; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm._batches import small_batches
from weft.llm._order import bucket_of, bucket_splits
from weft.session import materialize, table

PER_STRETCH = 64
_PERIOD = 1 << 12


@lru_cache(maxsize=1)
def _walk() -> tuple[np.ndarray, np.ndarray]:
    """Fixed draws: whether the cursor moves, by step (modulo the period) and character code; the digit of a code."""
    rng = np.random.default_rng(20240611)
    move = rng.integers(0, 2, (_PERIOD, 256)).astype(np.int64)
    move[:, 0] = 0  # the end mark holds the cursor
    digit = rng.integers(1, 16, 256).astype(np.uint8)
    digit[0] = 0
    return move, digit


@lru_cache(maxsize=64)
def _places(stretch: int) -> np.ndarray:
    """The sampled steps of stretch [2^stretch - 1, 2^(stretch+1) - 1), ascending."""
    first, n = (1 << stretch) - 1, 1 << stretch
    if n <= PER_STRETCH:
        return np.arange(first, first + n)
    # one place in each of 64 equal parts
    part = n // PER_STRETCH
    rng = np.random.default_rng(7919 + stretch)
    return first + np.arange(PER_STRETCH) * part + rng.integers(0, part, PER_STRETCH)


def _codes(text: str) -> np.ndarray:
    """One byte, 1 to 255, for each code point."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return ((x * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def fingerprints(texts: list[str | None], group_chars: int = 8 << 20) -> list[str]:
    """The fingerprint of each text."""
    out: list[str] = [""] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i] or ""))
    at = 0
    while at < len(order):  # texts of like length walk together
        to, size = at, 0
        while to < len(order) and (to == at or size < group_chars):
            size += len(texts[order[to]] or "") + 1
            to += 1
        for i, f in zip(order[at:to], _walked([texts[i] or "" for i in order[at:to]]), strict=True):
            out[i] = f
        at = to
    return out


def _walked(texts: list[str]) -> list[str]:
    """Fingerprints of texts that walk together."""
    move, digit = _walk()
    flat = np.zeros(sum(map(len, texts)) + len(texts), np.uint8)
    cursor = np.zeros(len(texts), np.int64)
    at = 0
    for i, t in enumerate(texts):
        cursor[i] = at
        flat[at : at + len(t)] = _codes(t)
        at += len(t) + 1
    alive = np.arange(len(texts))
    parts: list[list[bytes]] = [[] for _ in texts]
    hexes = np.frombuffer(b"0123456789abcdef", np.uint8)
    stretch, step = 0, 0
    while len(alive):
        begun, places = alive, _places(stretch).tolist()
        row = np.zeros(len(texts), np.int64)
        row[alive] = np.arange(len(alive))
        block = np.zeros((len(alive), len(places)), np.uint8)
        col, due = 0, places[0]
        for step in range(step, step + (1 << stretch)):
            code = flat[cursor]
            if step == due:
                block[row[alive], col] = digit[code]
                col += 1
                due = places[col] if col < len(places) else -1
            cursor += move[step & (_PERIOD - 1)][code]
            if step & 255 == 255 and not code.all():
                alive, cursor = alive[code != 0], cursor[code != 0]
                if not len(alive):
                    break
        step = (1 << (stretch + 1)) - 1
        reads = flat[cursor] != 0
        alive, cursor = alive[reads], cursor[reads]
        stretch += 1
        for i, digits in zip(begun.tolist(), hexes[block], strict=True):
            parts[i].append(digits.tobytes())
    return [b"".join(p).decode() for p in parts]


def likeness(a: str, b: str) -> float:
    """Share of the longer walk in which two fingerprints agree, less the one in 15 that chance gives; 0 to 1."""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    weight = _weights(n)
    p = np.frombuffer(a.ljust(n, "0").encode(), np.uint8)
    q = np.frombuffer(b.ljust(n, "0").encode(), np.uint8)
    read = weight * ((p != 48) | (q != 48))
    total = read.sum()
    return max(0.0, (read[p == q].sum() / total - 1 / 15) / (1 - 1 / 15)) if total else 0.0


@lru_cache(maxsize=256)
def _weights(n: int) -> np.ndarray:
    """Steps of the walk that each of the first ``n`` digits stands for."""
    out, k = [], 0
    while len(out) < n:
        m = min(1 << k, PER_STRETCH)
        out += [(1 << k) / m] * m
        k += 1
    return np.array(out[:n])


def fingerprint_documents(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (doc_id) and ``fingerprint`` of each row."""
    keep = ["doc_id"] if keep is None else keep
    udf = F.pandas_udf(lambda t: pd.Series(fingerprints(t.tolist()), dtype=object), "string")
    return small_batches(docs).select(*keep, udf(text).alias("fingerprint"))


BANDS, BAND_DIGITS = 24, 6


@lru_cache(maxsize=256)
def _picks(stretch: int, bands: int, digits: int) -> np.ndarray:
    """(bands, digits) places in a fingerprint, all in one stretch."""
    first, n = (1 << stretch) - 1, 1 << stretch
    if n > PER_STRETCH:
        first, n = PER_STRETCH - 1 + (stretch - PER_STRETCH.bit_length() + 1) * PER_STRETCH, PER_STRETCH
    return first + np.random.default_rng(104729 + stretch).integers(0, n, (bands, min(digits, n)))


def _n_stretches(fingerprint: str) -> int:
    n = len(fingerprint)
    return n.bit_length() if n < PER_STRETCH else PER_STRETCH.bit_length() - 1 + (n - PER_STRETCH + 1) // PER_STRETCH


def band_keys(fingerprint: str, bands: int = BANDS, digits: int = BAND_DIGITS) -> list[str]:
    """Bit-sampled bands: each joins digits drawn from one of the last three stretches of the walk. Bands that lie past the end of the text are left out."""
    own, count = np.frombuffer(fingerprint.encode(), np.uint8), _n_stretches(fingerprint)
    out = []
    for k in range(max(0, count - 3), count):
        got = own[_picks(k, bands, digits)]
        out += [f"{k}.{i}.{got[i].tobytes().decode()}" for i in np.flatnonzero((got != 48).any(axis=1) | (count == 1)).tolist()]
    return out


@lru_cache(maxsize=1024)
def _common(m: int, n: int, bands: int, digits: int) -> np.ndarray:
    """(bands, digits) places of all bands that fingerprints of ``m`` and of ``n`` stretches both have; short stretches' places are repeated."""
    each = [_picks(k, bands, digits) for k in range(max(0, m - 3, n - 3), min(m, n))]
    return np.concatenate([np.pad(p, ((0, 0), (0, digits - p.shape[1])), "edge") for p in each] or [np.zeros((0, digits), np.int64)])


def share_band(a: str, b: str, bands: int = BANDS, digits: int = BAND_DIGITS) -> bool:
    """Whether two fingerprints have a band in common, and so are candidates."""
    if a == b:
        return True
    m, n = _n_stretches(a), _n_stretches(b)
    places = _common(m, n, bands, digits)
    p, q = (np.frombuffer(f.encode(), np.uint8)[places] for f in (a, b))
    return bool(((p == q).all(axis=1) & ((p != 48).any(axis=1) | (m == n == 1))).any())


def near_documents(docs: DataFrame, text: str = "text", least: float = 0.8, queries: Column | None = None) -> DataFrame:
    """Pairs (query, found, likeness, rep_query, rep_found) of different fingerprints of likeness ``least`` or more that share a band.

    ``queries``: the rows that are looked for, against all rows; those whose doc_id is divisible by 20 if None. Rows of equal fingerprint are one
    class, named by its least doc_id: join ``fingerprint_documents`` on the fingerprint for membership. Bands are joined, candidates verified;
    a band that many classes have is split on both sides of the join by Spark, as it joins two plain tables.
    """
    asked = F.coalesce(F.col("doc_id") % 20 == 0 if queries is None else queries, F.lit(False))
    prints = fingerprint_documents(docs.withColumn("_asked", asked), text, ["doc_id", "_asked"])
    classes = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("representative"), F.max("_asked").alias("asked")), "classes")
    keys = F.pandas_udf(lambda f: pd.Series([band_keys(x) for x in f], dtype=object), "array<string>")
    banded = classes.select("fingerprint", "representative", "asked", F.explode(keys("fingerprint")).alias("band")).withColumn("band", F.xxhash64("band"))
    banded = materialize(banded, "bands")
    x, y = banded.where("asked").alias("x"), banded.alias("y")
    pairs = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.fingerprint") != F.col("y.fingerprint")))
    pairs = pairs.select(F.col("x.fingerprint").alias("query"), F.col("y.fingerprint").alias("found"), F.col("x.representative").alias("rep_query"), F.col("y.representative").alias("rep_found")).distinct()
    like = F.pandas_udf(lambda a, b: pd.Series([likeness(p, q) for p, q in zip(a, b, strict=True)], dtype="float64"), "double")
    return pairs.withColumn("likeness", like("query", "found")).where(F.col("likeness") >= least)


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of (bucket, sentinel, doc_id): each row but a sentinel against the next of its bucket."""
    held: tuple | None = None  # bucket, doc_id, text, fingerprint of the row that waits for the next
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_banded", "next_banded"]
    for pdf in parts:
        if pdf.empty:
            continue
        texts = ["" if t is None else t for t in pdf["text"]]
        prints = fingerprints(texts)
        rows = list(zip(pdf["_bucket"].tolist(), pdf["_sentinel"].tolist(), pdf["doc_id"].tolist(), texts, prints, strict=True))
        pairs = []
        for row in rows:
            if held is not None:
                pairs.append((held, row))
            held = None if row[1] else row
        edited = [edited_text(a[3], b[3]) for a, b in pairs]
        out = []
        for (a, b), e, f in zip(pairs, edited, fingerprints(edited), strict=True):
            sha = hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((a[2], len(a[3]), sha, a[4], f, likeness(a[4], f), likeness(a[4], b[4]), share_band(a[4], f), share_band(a[4], b[4])))
        if out:
            got = pd.DataFrame(out, columns=columns)
            got["doc_id"] = got["doc_id"].astype("Int64")
            yield got


def against_edited(docs: DataFrame, text: str = "text") -> DataFrame:
    """Fingerprint of each row's text and of its text edited with the next row's (ascending doc_id, the first after the last), likenesses, and whether banding finds the pairs.

    Rows are dealt by ranges of doc_id and sorted there; the first row of each range also stands behind the
    range before it, so no row needs more than its own range.
    """
    rows = small_batches(docs).select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    splits = bucket_splits(rows)
    rows = rows.withColumn("_bucket", bucket_of(splits))
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "_tie")
    heads = rows.groupBy("_bucket").agg(F.min(place).alias("h")).orderBy("_bucket").collect()  # one small row for each bucket, at most MAX_BUCKETS + 1
    before = [(r["_bucket"], r["h"]["doc_id"], r["h"]["_tie"], heads[i - 1]["_bucket"]) for i, r in enumerate(heads)]
    heads = docs.sparkSession.createDataFrame(before, "_bucket int, head bigint, _tie bigint, _before int")
    first = (
        rows.join(F.broadcast(heads), ["_bucket", "_tie"])
        .where(F.col("doc_id").eqNullSafe(F.col("head")))
        .groupBy("_before")
        .agg(F.first(F.struct("doc_id", "text", "_tie")).alias("s"))  # rows of equal id and text are the same
        .select("s.*", F.col("_before").alias("_bucket"), F.lit(1).alias("_sentinel"))
    )
    dealt = rows.withColumn("_sentinel", F.lit(0)).unionByName(first).repartition("_bucket").sortWithinPartitions("_bucket", "_sentinel", F.asc_nulls_first("doc_id"), "_tie")
    return dealt.mapInPandas(
        _compare,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_banded boolean, next_banded boolean",
    )


def op8_edit_fingerprints(spark, sf_dir: str) -> DataFrame:
    return against_edited(table(spark, sf_dir, "documents"))
