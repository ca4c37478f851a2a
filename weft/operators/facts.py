"""Facts from source text (cs_id, path, content), by patterns over tokens, in column functions only.

Strings, templates and comments are told apart first, then top-level declarations and module names are read line by line. There is no type
checker: names inside template expressions, and declarations inside of namespaces, aren't found. Null and empty texts have no facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_STRINGS = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|' + r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|" + r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
TOKENS = _STRINGS + r"|//[^\n]*|/\*[\s\S]*?\*/|[^\"'`/]+|[\"'`/]"
DECLARATION = r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function|class|interface|type|enum|namespace|const|let|var)\b\*?\s+([A-Za-z_$][\w$]*)"
MODULE = r"(?:\bfrom|\bimport|\bimport\s*\(|\brequire\s*\()\s*[\"']([^\"'\n]+)[\"']"
BINDING = r"\bimport\s+(?:type\s+)?([^\"';()]+?)\s+from\s*[\"']([^\"'\n]+)[\"']"


def _tokens(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(TOKENS), 0)


def _is_comment(token: Column) -> Column:
    return token.startswith("//") | token.startswith("/*")


def code(content: Column) -> Column:
    """The text without comments; line numbers stay."""
    lines = lambda t: F.regexp_replace(t, "[^\n]", "")
    return F.array_join(F.transform(_tokens(content), lambda t: F.when(_is_comment(t), lines(t)).otherwise(t)), "")


def skeleton(content: Column) -> Column:
    """The text without comments and the insides of strings; line numbers stay."""
    lines = lambda t: F.regexp_replace(t, "[^\n]", "")
    quoted = lambda t: (F.length(t) > 1) & t.rlike("^[\"'`]")
    return F.array_join(F.transform(_tokens(content), lambda t: F.when(_is_comment(t), lines(t)).when(quoted(t), F.concat(F.lit('""'), lines(t))).otherwise(t)), "")


def modules(files: DataFrame) -> DataFrame:
    """(cs_id, path, module): modules that each file imports, re-exports or requires."""
    return files.select("cs_id", "path", F.explode(F.regexp_extract_all(code(F.col("content")), F.lit(MODULE), 1)).alias("module")).distinct()


def bindings(files: DataFrame) -> DataFrame:
    """(cs_id, path, local, imported, module): names that imports bind; imported is 'default', '*' or the name exported."""
    text = code(F.col("content"))
    found = files.select("cs_id", "path", F.explode(F.arrays_zip(F.regexp_extract_all(text, F.lit(BINDING), 1).alias("names"), F.regexp_extract_all(text, F.lit(BINDING), 2).alias("module"))).alias("b"))
    inner = F.regexp_extract("b.names", r"\{([^}]*)\}", 1)
    outer = F.regexp_replace("b.names", r"\{[^}]*\}", "")
    one = lambda local, imported: F.struct(local.alias("local"), imported.alias("imported"))
    named = F.transform(F.split(inner, ","), lambda x: one(F.regexp_extract(x, r"([\w$]+)\s*$", 1), F.regexp_extract(F.regexp_replace(x, r"^\s*type\s+(?=[\w$]+\s*($|as\b))", ""), r"^\s*([\w$]+)", 1)))
    plain = F.transform(F.split(outer, ","), lambda x: one(F.regexp_extract(x, r"([\w$]+)\s*$", 1), F.when(x.contains("*"), F.lit("*")).otherwise(F.lit("default"))))
    return found.select("cs_id", "path", F.explode(F.concat(plain, named)).alias("x"), F.col("b.module").alias("module")).where("x.local <> ''").select("cs_id", "path", "x.local", "x.imported", "module")


def declarations(files: DataFrame) -> DataFrame:
    """(cs_id, path, name, kind, start_line, end_line): top-level declarations, from their first line to the one that closes their brackets. Lines count from 1."""
    rows = files.select("cs_id", "path", F.posexplode(F.split(skeleton(F.col("content")), "\n", -1)).alias("at", "line"))
    step = F.length(F.regexp_replace("line", r"[^{(\[]", "")) - F.length(F.regexp_replace("line", r"[^})\]]", ""))
    by = W.partitionBy("cs_id", "path").orderBy("at")
    rows = rows.withColumn("after", F.sum(step).over(by.rowsBetween(W.unboundedPreceding, 0))).withColumn("before", F.col("after") - step)
    closes = F.min(F.when(F.col("after") <= 0, F.col("at"))).over(by.rowsBetween(0, W.unboundedFollowing))
    last = F.max("at").over(W.partitionBy("cs_id", "path"))
    rows = rows.withColumn("end", F.coalesce(closes, last)).where("before <= 0").withColumn("name", F.regexp_extract("line", DECLARATION, 2)).where("name <> ''")
    return rows.select("cs_id", "path", "name", F.regexp_extract("line", DECLARATION, 1).alias("kind"), (F.col("at") + 1).alias("start_line"), (F.col("end") + 1).alias("end_line"))
