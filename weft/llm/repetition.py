"""Quality rules by repetition coverage: how many characters lie inside repeated n-grams and lines.

Per text, words become small integer ids, and a polynomial rolling hash over those ids gives the hash of
every n-gram of each length in numpy. Equal hashes are checked id by id, so a collision never counts as a
repeat. The characters of all words inside any repeated n-gram (first occurrence included) make that
length's coverage. A text is rejected if a coverage passes its limit.

Cases: a null or empty text has no words and fails the base rule; texts of any length are handled whole;
repeated rows give repeated results; other columns are ignored, or kept as they are whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._batches import small_batches
from weft.llm._columns import free_names, numbered

#: Share of word characters that repeated n-grams of a length may cover.
COVERAGE_LIMITS = {5: 0.25, 7: 0.22, 10: 0.20}
#: Share of word characters that lines equal to an earlier line may hold.
LINE_CHARS_LIMIT = 0.30
SYMBOLS = b"#*$%&|<>"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NOT_SYMBOL = bytes(i for i in range(256) if i not in SYMBOLS)


def _same_as_another(ids: np.ndarray, n: int) -> np.ndarray:
    """For each n-gram start: whether the n-gram occurs at another start too."""
    m = len(ids) - n + 1
    if m < 2:
        return np.zeros(max(m, 0), bool)
    x = ids.astype(np.uint64) * _BASE + np.uint64(0x632BE59BD9B4E019)
    x ^= x >> np.uint64(29)
    h = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = h * np.uint64(0xD6E8FEB86659FD93) + x[k : k + m]
    order = np.argsort(h, kind="stable")
    s = h[order]
    equal = s[1:] == s[:-1]
    out = np.zeros(m, bool)
    if equal.any():
        a, b = order[:-1][equal], order[1:][equal]
        true = np.ones(len(a), bool)
        for k in range(n):
            true &= ids[a + k] == ids[b + k]
        if not true.all():  # a collision: compare whole n-grams instead
            grams = np.lib.stride_tricks.sliding_window_view(ids, n)
            _, back, count = np.unique(grams, axis=0, return_inverse=True, return_counts=True)
            return count[back.ravel()] > 1
        out[a] = out[b] = True
    return out


def _inside(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words that some marked n-gram covers."""
    edge = np.zeros(words + 1, np.int32)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def repetition(text: str | None, lengths: tuple[int, ...] = tuple(COVERAGE_LIMITS)) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, *covered characters by length)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() splits at exactly \x20 and \x09-\x0d
    n = len(words)
    n_symbols = len(raw.translate(None, _NOT_SYMBOL))
    word_chars = len(text or "") - sum(map((text or "").count, " \t\n\v\f\r"))
    seen: set[bytes] = set()
    dup_lines = dup_chars = 0
    for line in raw.split(b"\n"):
        if line.strip():
            if line in seen:
                dup_lines += 1
                dup_chars += len(b"".join(line.split()).decode("utf-8", "surrogatepass"))
            else:
                seen.add(line)
    covered, repeat_words = [0] * len(lengths), 0
    if n > min(5, *lengths):
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        if len(number) < n:
            fives = _inside(_same_as_another(ids, 5), 5, n) if n > 5 else np.zeros(n, bool)
            repeat_words = int(fives.sum())
            chars = None
            for i, k in enumerate(lengths):
                if n > k and (repeat_words or k < 5):  # what repeats in more than five words repeats in five
                    inside = fives if k == 5 else _inside(_same_as_another(ids, k), k, n)
                    if inside.any():
                        chars = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, n) if chars is None else chars
                        covered[i] = int(chars[inside].sum())
    return (n, word_chars, n_symbols, dup_lines, repeat_words, dup_chars, *covered)


def quality_rules(docs: DataFrame, text: str = "text", limits: dict[int, float] | None = None, line_limit: float = LINE_CHARS_LIMIT, keep: list[str] | None = None) -> DataFrame:
    """Repetition figures and verdict of each row of ``docs``, beside the columns named in ``keep`` (doc_id).

    Where a kept column has the name of a figure, the figure's column has an underscore behind it.
    """
    limits = dict(limits or COVERAGE_LIMITS)
    keep = ["doc_id"] if keep is None else keep
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"covered_{k}" for k in limits)]
    fields = ", ".join(f"{x} bigint" for x in names)

    def rate(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([repetition(t, tuple(limits)) for t in texts], columns=names).astype("int64")

    rows, at = numbered(small_batches(docs))
    found = rows.select(*[at[c] for c in keep], F.pandas_udf(rate, f"struct<{fields}>")(at[text]).alias("_r")).select(*[at[c] for c in keep], "_r.*")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    share = lambda c: F.col(c) / F.greatest(F.col("word_chars"), F.lit(1))
    passes = share("dup_line_chars") <= line_limit
    for k, most in limits.items():
        passes &= share(f"covered_{k}") <= most
    rated = found.withColumns({"base_failed": base}).withColumn("kept", ~F.col("base_failed") & passes)
    return rated.toDF(*keep, *free_names([*names, "base_failed", "kept"], keep))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    rows, at = numbered(docs)
    rated = quality_rules(rows, at[text], keep=rows.columns)
    return rated.where("kept").select(*rows.columns).toDF(*docs.columns)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    from weft.session import table

    return quality_rules(table(spark, sf_dir, "documents"))
