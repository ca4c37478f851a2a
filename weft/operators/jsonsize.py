"""Size and depth of JSON texts without building them: their tokens, and one fold over each text's tokens. Column functions only.

The size is that of the text's value written with two blanks of indentation and a line end, in UTF-8 bytes, numbers as doubles in their shortest form.
A text may be nested at any depth: no stack is kept, only how many brackets are open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES, MAX_DEPTH = 100 << 20, 64
_READABLE = 500  # levels up to which Spark's own parser says whether a text is JSON; a deeper one is refused for its depth
_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:[ \t\n\r]*+:)?|[\[\]{}]|[^ \t\n\r,:\[\]{}"]++'  # a name keeps its colon
_ESCAPE = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\."
#: Escapes and the bytes by which each is longer than what is written for its character; the first that fits counts, others are as long.
_LONGER = (
    (r"^\\/$", 1), (r"^.{12}$", 8), (r"^\\u00(?:0[89aAcCdD]|22|5[cC])$", 4), (r"^\\u00[01]", 0), (r"^\\u00[2-7]", 5), (r"^\\u0[0-7]", 4), (r"^\\u[dD][89a-fA-F]", 0), (r"^\\u", 3),
)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(text: Column) -> Column:
    """(k, point): how many digits a number's text has, without zeros around them, and the power of ten that 0.digits is taken times."""
    mantissa, power = F.regexp_extract(text, "^([^e]*)", 1), F.coalesce(F.regexp_extract(text, "e(.*)$", 1).try_cast("int"), F.lit(0))
    both = F.regexp_replace(mantissa, "[.]", "")
    behind = F.length(F.regexp_replace(both, "^0+", ""))
    k = F.length(F.regexp_replace(both, "^0+|0+$", ""))
    return F.struct(k.alias("k"), (F.length(F.substring_index(mantissa, ".", 1)) + power - F.length(both) + behind).alias("point"))


def _shortest(size: Column, text: Column, at: Column) -> Column:
    """Java before 19 writes some numbers with a digit more than they need, so one less is tried."""
    some = (at["k"] >= 15) | ((at["k"] == 2) & (size < 1e-300))
    less = F.when(some, F.call_function("format_string", F.concat(F.lit("%."), (at["k"] - 2).cast("string"), F.lit("e")), size))
    return _let(less, lambda x: F.when(x.try_cast("double") == size, _digits(x)).otherwise(at))


def number_length(number: Column) -> Column:
    """Characters of a finite double written as JavaScript does."""

    def written(at: Column) -> Column:
        k, point = at["k"], at["point"]
        small = F.when(k <= point, point).when(point > 0, k + 1).otherwise(2 - point + k)
        long = k + F.when(k > 1, 1).otherwise(0) + 2 + F.length(F.abs(point - 1).cast("string"))
        return F.when((point > -6) & (point <= 21), small).otherwise(long)

    def positive(size: Column) -> Column:
        return _let(F.lower(size.cast("string")), lambda text: _let(_let(_digits(text), lambda at: _shortest(size, text, at)), written))

    return _let(number, lambda x: F.when(x == 0, 1).otherwise(_let(F.abs(x), positive) + F.when(x < 0, 1).otherwise(0)))


def _saved(text: Column) -> Column:
    """Bytes by which a text's escapes are longer than what is written for them. Backslashes stand in strings alone, so the whole text is looked at."""

    def one(escape: Column) -> Column:
        out = F.lit(0)
        for pattern, n in reversed(_LONGER):
            out = F.when(escape.rlike(pattern), n).otherwise(out)
        return out

    escapes = F.regexp_extract_all(text, F.lit(_ESCAPE), F.lit(0))
    return F.aggregate(escapes, F.lit(0).cast("bigint"), lambda a, e: a + one(e))


def measured(text: Column) -> Column:
    """(depth: of the deepest value, the outermost one's is 0; bytes; finite: whether all numbers are) of a JSON text."""
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("depth"), F.lit(1).cast("bigint").alias("bytes"), F.lit(True).alias("finite"), F.lit(False).alias("fresh"))

    def step(at: Column, token: Column) -> Column:
        number = F.when(F.substring(token, 1, 1).rlike("[-0-9]"), token.try_cast("double"))
        return _let(number, lambda x: after(at, token, x))

    def after(at: Column, token: Column, number: Column) -> Column:
        n, first = at["open"], F.substring(token, 1, 1)
        opens, closes, name = first.isin("[", "{"), first.isin("]", "}"), token.endswith(":")
        scalar = F.when(number.isNotNull(), number_length(number)).otherwise(F.octet_length(token))
        indent = F.when(n > 0, 2 * n + 2).otherwise(0)  # of a value inside another one, with what separates it from the next
        size = F.when(closes, F.when(at["fresh"], 2).otherwise(2 * n)).when(name, F.octet_length(F.regexp_replace(token, "[ \t\n\r]*:$", "")) + 2).when(opens, indent).otherwise(indent + scalar)
        deeper = F.when(closes | name, at["depth"]).otherwise(F.greatest(at["depth"], n))
        finite = at["finite"] & F.coalesce(F.abs(number) < float("inf"), F.lit(True))
        return F.struct((n + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("open"), deeper.alias("depth"), (at["bytes"] + size).alias("bytes"), finite.alias("finite"), opens.alias("fresh"))

    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    return F.aggregate(tokens, start, step, lambda at: F.struct(at["depth"].alias("depth"), (at["bytes"] - _saved(text)).alias("bytes"), at["finite"].alias("finite")))


def json_sizes(rows: DataFrame, text: str, max_bytes: int = MAX_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(all other columns, depth, bytes, refused) of each row's JSON ``text``: refused is the first of json (null, broken, or a name twice in an object), depth,
    number (one beyond doubles) and size that applies, else null. Depth and bytes are null where the text isn't JSON."""
    if not (isinstance(max_bytes, int) and max_bytes > 0 and 0 <= max_depth <= _READABLE):
        raise ValueError(f"limits must be positive, the depth at most {_READABLE}")
    key = [c for c in rows.columns if c != text]
    m = F.col("_m")
    found = rows.select(*key, F.col(text).alias("_text"), measured(F.col(text)).alias("_m"))
    valid = F.when(m["depth"] <= _READABLE, F.try_parse_json("_text").isNotNull()).otherwise(F.col("_text").isNotNull())
    found = found.select(*key, "_m", F.coalesce(valid, F.lit(False)).alias("_valid"))
    why = F.when(~F.col("_valid"), "json").when(m["depth"] > max_depth, "depth").when(~m["finite"], "number").when(m["bytes"] > max_bytes, "size")
    return found.select(*key, *[F.when(F.col("_valid"), m[c]).alias(c) for c in ("depth", "bytes")], why.alias("refused"))
