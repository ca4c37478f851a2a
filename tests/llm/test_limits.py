"""Every figure of the repetition rules by brute force, short n-grams included, and the mix's exchange in sessions without adaptive execution."""

import collections
import random
import re

import pytest

from weft.llm import mixing, repetition


def figures(text, lengths, line_limit, limits):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    size = sum(map(len, w))

    def covered(k):
        grams = collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        inside = {j for i in range(len(w) - k + 1) if grams[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        return inside, sum(len(w[j]) for j in inside)

    seen, lines, chars = set(), 0, 0
    for x in (text or "").split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", x)
        if own:
            lines, chars = (lines + 1, chars + sum(map(len, own))) if x in seen else (lines, chars)
            seen.add(x)
    repeat = len(covered(5)[0])
    by = [covered(k)[1] for k in lengths]
    failed = len(w) < 10 or 100 * repeat > 20 * len(w)
    kept = not failed and chars / max(size, 1) <= line_limit and all(c / max(size, 1) <= limits[k] for k, c in zip(lengths, by, strict=True))
    return (len(w), size, lines, repeat, chars, *by, failed, kept)


@pytest.mark.parametrize("limits", [repetition.COVERAGE_LIMITS, {3: 0.2}, {2: 0.5, 4: 0.3, 5: 0.25, 8: 0.1}])
def test_every_figure_and_the_verdict(spark, limits):
    rng = random.Random(11)
    line = lambda n, m: " ".join(rng.choice(["é", "ab", "日本", "x1", *(f"w{i}" for i in range(m))]) for _ in range(n))
    texts = [None, "", " \n", "a b c x a b c y a b c z a b c w", "a " * 30, "a b a b a b", "one two three four five", "same line here\n" * 4 + line(60, 90)]
    texts += ["\n".join(line(rng.randint(1, 9), rng.choice([1, 8, 60, 400])) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    texts += [(t := line(40, 300)) + "\n" + t[:60] for _ in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in repetition.quality_rules(df, limits=limits).collect()}
    for i, t in enumerate(texts):
        r, names = got[i], [f"covered_{k}" for k in limits]
        own = (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words, r.dup_line_chars, *[r[n] for n in names], r.base_failed, r.kept)
        assert own == figures(t, list(limits), repetition.LINE_CHARS_LIMIT, limits), t
    assert {r.kept for r in got.values()} == {True, False}


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_the_mix_is_dealt_anew_in_any_session(spark, adaptive):
    other = spark.newSession()
    other.conf.set("spark.sql.adaptive.enabled", adaptive)
    other.conf.set("spark.sql.shuffle.partitions", "6")
    rows = [(i, f"t{i}", "a" if i % 3 else "b") for i in range(400)] + [(7, "t7", "a")] * 300
    docs = other.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    mixed = mixing.mix_sources(docs)
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan[: plan.index("Generate")]
    parts = mixed.selectExpr("*", "spark_partition_id() AS part").collect()
    sizes = collections.Counter(r.part for r in parts)
    if adaptive == "false":
        assert len(sizes) == 6 and max(sizes.values()) < 0.5 * len(parts)  # equal rows, 3 of 7, don't meet in one part
    for part in sizes:
        keys = [r.shuffle_key for r in parts if r.part == part]
        assert keys == sorted(keys)
