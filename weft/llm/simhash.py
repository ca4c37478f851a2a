"""SimHash near-duplicates through Golay-code fuzzy keys.

A fingerprint has 64 bits, one per bit position of the XXH64 hashes of a text's three-word shingles (set in
over half of them). Two fingerprints link at 3 or fewer differing bits. To find links without comparing
all pairs, the 64 bits are three segments A (23 bits), B (23) and C (18, padded with zeros to 23). The
perfect binary Golay code (23, 12, 7) maps each 23-bit word to one codeword within distance 3. Decoding a
segment and all its one-bit neighbours gives 1 or 6 codeword indices; if two segments differ in one bit at
most, the index of one is among those of the other's neighbourhood. With 3 errors over three segments

* either some segment has no error and another has one at most: its exact bits and the other segment's
  codeword index make a key (six ordered pairs of segments), or
* all three have exactly one error: the codeword indices of A and B and the parities of all three segments,
  each of which then flips, make the key.

One side of the join carries the several keys of a fingerprint (at most 6 * 6 + 36, in the mean about 60), the other its seven
plain keys, so every link is met in either direction. Candidates are then verified bit by bit. The join
runs over distinct fingerprints, so any number of equal copies costs one row.

Cases: a null, empty or wordless text has fingerprint zero and links like any other; texts are read whole;
rows that repeat a doc_id link to each other only through their fingerprints; a null doc_id gets its own
fingerprint and the component of its fingerprint (null if no row of the component has an id); an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._batches import small_batches
from weft.llm._columns import numbered
from weft.operators.components import connected_components
from weft.session import checkpoint, materialize, table

MAX_BITS = 3
SEGMENTS = ((0, 23), (23, 23), (46, 18))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, seed) for g in grams], "<u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        part = h[at : at + 8192]
        total += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64).sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * total > len(h)).astype(np.uint64)).sum(dtype=np.uint64)) if (2 * total > len(h)).any() else 0


def _remainder(word: np.ndarray) -> np.ndarray:
    """Syndrome: the 11-bit remainder of each 23-bit word modulo the generator."""
    r = word.astype(np.int64)
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ (_GENERATOR << (bit - 11)), r)
    return r


@lru_cache(maxsize=1)
def golay_index() -> np.ndarray:
    """For each of the 2^23 words, the 12-bit index of the codeword within distance 3 (uint16, 16 MB)."""
    bits = np.int64(1) << np.arange(23)
    errors = [np.zeros(1, np.int64), bits]
    i, j = np.triu_indices(23, 1)
    errors.append(bits[i] | bits[j])
    a, b, c = (x.ravel() for x in np.meshgrid(*[np.arange(23)] * 3, indexing="ij"))
    up = (a < b) & (b < c)
    errors.append(bits[a[up]] | bits[b[up]] | bits[c[up]])
    leader = np.zeros(2048, np.int64)
    e = np.concatenate(errors)
    leader[_remainder(e)] = e
    low = _remainder(np.arange(2048))
    high = _remainder(np.arange(4096) << 11)
    out = np.empty((4096, 2048), np.uint16)
    for top in range(4096):
        word = top << 11 | np.arange(2048)
        out[top] = (word ^ leader[low ^ high[top]]) >> 11
    return out.ravel()


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    return [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]


def _parity(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64) & 1


def _near(segment: np.ndarray, width: int) -> np.ndarray:
    """(rows, 6) codeword indices of a segment and its one-bit neighbours, padded with -1."""
    ball = segment[:, None] ^ np.concatenate([[0], np.int64(1) << np.arange(width)])
    found = np.sort(golay_index()[ball].astype(np.int64), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return -np.sort(-found, axis=1)[:, :6]


_ORDERED = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))


def plain_keys(fp: np.ndarray) -> np.ndarray:
    """(rows, 7) keys, each fingerprint under its own codewords."""
    s = _segments(fp)
    own = [golay_index()[x].astype(np.int64) for x in s]
    keys = [t << 36 | s[i] << 12 | own[j] for t, (i, j) in enumerate(_ORDERED)]
    par = _parity(s[0]) << 2 | _parity(s[1]) << 1 | _parity(s[2])
    keys.append(6 << 36 | par << 24 | own[0] << 12 | own[1])
    return np.stack(keys, axis=1)


def fuzzy_keys(fp: np.ndarray) -> np.ndarray:
    """(rows, 72) keys, each fingerprint under all codewords nearby, padded with -1."""
    s = _segments(fp)
    near = [_near(x, n) for x, (_, n) in zip(s, SEGMENTS, strict=True)]
    parts = [np.where(near[j] >= 0, t << 36 | s[i][:, None] << 12 | near[j], -1) for t, (i, j) in enumerate(_ORDERED)]
    par = ((1 - _parity(s[0])) << 2 | (1 - _parity(s[1])) << 1 | (1 - _parity(s[2])))[:, None, None]
    a, b = near[0][:, :, None], near[1][:, None, :]
    parts.append(np.where((a >= 0) & (b >= 0), 6 << 36 | par << 24 | a << 12 | b, -1).reshape(len(fp), -1))
    return np.concatenate(parts, axis=1)


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (doc_id) and ``fp`` (bigint) for each row."""

    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    keep = ["doc_id"] if keep is None else keep
    return small_batches(docs).select(*keep, F.pandas_udf(hashed, "bigint")(text).alias("fp"))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints in ``fps.fp`` that differ in ``max_bits`` (3 at most) bits."""
    if max_bits > MAX_BITS:
        raise ValueError("the keys are complete up to 3 differing bits")

    def keyed(make, width):
        def udf(fp: pd.Series) -> pd.Series:
            keys = make(fp.to_numpy(np.int64).view(np.uint64))
            return pd.Series([k[k >= 0] for k in keys], dtype=object)

        return F.pandas_udf(udf, "array<bigint>")

    # the key tables are filled per Arrow batch of fingerprints
    probe = fps.select(F.col("fp").alias("a"), F.explode(keyed(fuzzy_keys, 72)("fp")).alias("key"))
    index = fps.select(F.col("fp").alias("b"), F.explode(keyed(plain_keys, 7)("fp")).alias("key"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return probe.join(index, "key").where(near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", max_bits: int = MAX_BITS, keep: list[str] | None = None) -> DataFrame:
    """``keep``, fingerprint (hex), component_id (smallest doc_id reachable) and component (a fingerprint that names it) of each row."""
    keep = ["doc_id"] if keep is None else keep
    rows = materialize(fingerprints(docs, text, keep), "simhash")
    groups = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = connected_components(links(groups.select("fp"), max_bits), "a", "b")
    member = groups.join(joined, groups["fp"] == joined["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    component = member.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = member.join(component, "component").select("fp", "component_id", "component")
    return rows.join(labels, "fp").select(*keep, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component")


def keep_one_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest doc_id (the first by text of rows that repeat it)."""
    rows, at = numbered(docs)
    rows = rows.withColumn("_text_key", F.xxhash64(F.coalesce(F.col(at[text]), F.lit("")))).withColumn("doc_id", F.col(at["doc_id"]))
    rated = near_duplicates(rows, at[text], keep=["doc_id", "_text_key"])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text_key")).alias("s")
    stay = rated.groupBy("component").agg(first).select(F.col("s.doc_id").alias("_id"), F.col("s._text_key").alias("_key"))
    same = rows.join(stay, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left_semi")
    return same.dropDuplicates(["doc_id", "_text_key"]).select(*at.values()).toDF(*docs.columns)


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("component")
