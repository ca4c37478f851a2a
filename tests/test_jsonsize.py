"""Sizes and depths of JSON texts against Python's own writer; numbers against their known forms."""

import json
import random

from pyspark.sql import functions as F

from weft.operators import jsonsize

NUMBERS = {
    "0": "0", "-0": "0", "-0.0": "0", "1": "1", "1.50": "1.5", "-12.5": "-12.5", "100": "100", "1e2": "100", "1E20": "100000000000000000000", "1e21": "1e+21", "1.5e300": "1.5e+300", "123456789012345678": "123456789012345680",
    "0.000001": "0.000001", "1e-7": "1e-7", "-1.25e-9": "-1.25e-9", "0.1": "0.1", "0.30000000000000004": "0.30000000000000004", "5e-324": "5e-324", "2e-323": "2e-323", "8.41e21": "8.41e+21", "2.0e-3": "0.002", "123456.7890123456": "123456.7890123456", "1.7976931348623157e308": "1.7976931348623157e+308",
}


def test_numbers(spark):
    got = spark.createDataFrame([(k,) for k in NUMBERS], "t string").select("t", jsonsize.number_length(F.col("t").cast("double")).alias("n")).collect()
    assert {r.t: r.n for r in got} == {k: len(v) for k, v in NUMBERS.items()}
    texts = spark.createDataFrame([(k,) for k in NUMBERS], "t string")
    assert {r.k: r.bytes for r in jsonsize.json_sizes(texts.withColumn("k", F.col("t")), "t").collect()} == {k: len(v) + 1 for k, v in NUMBERS.items()}


def _value(rng, depth):
    kind = rng.randrange(8 if depth < 5 else 5)
    if kind < 2:
        return "".join(rng.choice(['a', '"', "\\", "/", "\n", "\x01", "\x7f", "é", "€", "😀", "\b", ":", "{", "]", ",", "\\u0041", "\x1f"]) for _ in range(rng.randrange(8)))
    if kind < 5:
        return rng.choice([None, True, False, 7, -3])
    items = [_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return items if kind < 7 else {str(i) + rng.choice(["", '"', "é", "a b:"]): x for i, x in enumerate(items)}


def _depth(value):
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return max((1 + _depth(x) for x in inner), default=0)


def test_values_as_python_writes_them(spark):
    rng = random.Random(3)
    values = [_value(rng, 0) for _ in range(300)]
    rows = [(i, json.dumps(v, ensure_ascii=i % 2 == 0, indent=rng.choice([None, 1, 7]), separators=(",", rng.choice([":", " : "]))).replace("/", rng.choice(["/", "\\/"])), "x") for i, v in enumerate(values)]
    got = {r.id: r for r in jsonsize.json_sizes(spark.createDataFrame(rows, "id int, text string, depth_ string"), "text").collect()}
    for i, v in enumerate(values):
        assert (got[i].depth, got[i].bytes, got[i].refused) == (_depth(v), len(json.dumps(v, indent=2, ensure_ascii=False).encode()) + 1, None), rows[i]


def test_refusals(spark):
    deep = lambda n: "[" * n + "]" * n
    cases = {
        "none": (None, "json"), "empty": ("", "json"), "broken": ('{"a": [1}', "json"), "twice": ('{"a":1,"a":2}', "json"), "at limit": (deep(65), None), "over": (deep(66), "depth"), "far over": (deep(20000), "depth"),
        "infinite": ("[1e999]", "number"), "long": ('"' + "x" * 200 + '"', "size"), "long escapes": ('"' + "\\n" * 99 + '"', None), "lone": ('"\\ud800"', None), "pair": ('"\\ud83d\\ude00"', None), "empties": ("[[],{}]", None),
    }
    rows = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "k string, t string")
    got = {r.k: r for r in jsonsize.json_sizes(rows, "t", max_bytes=100000).where("k <> 'long'").collect()}
    assert {k: r.refused for k, r in got.items()} == {k: w for k, (_, w) in cases.items() if k != "long"}
    assert got["at limit"].depth == 64 and got["far over"].depth == 19999 and got["none"].bytes is None and got["pair"].bytes == 7 and got["empties"].bytes == len("[\n  [],\n  {}\n]\n")
    short = jsonsize.json_sizes(rows.where("k IN ('long', 'long escapes')"), "t", max_bytes=202).collect()
    assert {r.k: (r.bytes, r.refused) for r in short} == {"long": (203, "size"), "long escapes": (201, None)}
    assert jsonsize.json_sizes(rows.limit(0), "t").count() == 0
    many = spark.createDataFrame([("m", json.dumps(["\n" * 5000] * 4 + list(range(20000))))], "k string, t string")
    assert jsonsize.json_sizes(many, "t").first().bytes == len(json.dumps(["\n" * 5000] * 4 + list(range(20000)), indent=2)) + 1
