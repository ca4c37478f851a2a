"""Queries on source text. No given table holds any, so documents are laid out as source by arithmetic: nested functions that bind, shadow and name variables,
and two versions of functions and types. The SQL says by the same arithmetic, and by walking scopes outwards, what must be found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators import analysis, source
from weft.plans.queries import query
from weft.session import table

#: Of each document d, functions f0, f1, ... up to its depth, each in the one before: variable, use and arrow of level j, and its parameter where it has one.
LEVELS = """lv AS (SELECT doc_id AS d, 'd' || doc_id || '.ts' AS path, doc_id % 5 + 1 AS k, unnest(range(doc_id % 5 + 1)) AS j FROM documents),
  l AS (SELECT *, (d * 7 + j * 3) % 5 AS a, (d + 2 * j) % 5 AS u, (d + 3 * j) % 5 AS p, (d + 3 * j + j % 2) % 5 AS w, CASE WHEN (d + j) % 3 = 0 THEN ((d * 7 + j * 3) % 5 + 1 + d % 4) % 5 END AS q,
    path || '#' || list_aggregate(list_transform(range(j + 1), lambda x: 'f' || x), 'string_agg', '.') AS own FROM lv)"""


def _n(c: Column | int, m: int) -> Column:
    return F.pmod(c, F.lit(m)).cast("string")


def _nested(spark, sf: str) -> DataFrame:
    """files of nested functions: two lines at the top, four for each level, then the closing brackets."""
    d, k = F.col("doc_id"), F.pmod("doc_id", F.lit(5)) + 1

    def level(j: Column) -> Column:
        name = _n(d * 7 + j * 3, 5)
        q = F.pmod(F.pmod(d * 7 + j * 3, F.lit(5)) + 1 + F.pmod(d, F.lit(4)), F.lit(5)).cast("string")
        parameter = F.when(F.pmod(d + j, F.lit(3)) == 0, F.concat(F.lit("v"), q)).otherwise("")
        of = j.cast("string")
        return F.concat(
            F.lit("function f"), of, F.lit("("), parameter, F.lit(") {\nlet v"), name, F.lit(" = "), of, F.lit(";\nuse(`a}'${v"), _n(d + j * 2, 5), F.lit("}`, f"), of, F.lit(");\nconst g"), of,
            F.lit(" = (v"), _n(d + j * 3, 5), F.lit(") => v"), _n(d + j * 3 + F.pmod(j, F.lit(2)), 5), F.lit(";\n"),
        )

    top = F.concat(F.when(F.pmod(d, F.lit(2)) == 0, F.concat(F.lit("import { a as v4 } from './m"), _n(d, 3), F.lit("'; // {\n"))).otherwise("/* { */\n"), F.lit("const v"), _n(d, 4), F.lit(" = 9;\n"))
    body = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), k - 1), level), "")
    path = F.concat(F.lit("d"), d.cast("string"), F.lit(".ts"))
    return table(spark, sf, "documents").select(F.pmod(d, F.lit(10)).alias("cs_id"), F.lit("new").alias("side"), path.alias("path"), F.concat(top, body, F.expr("repeat('}\n', int(pmod(doc_id, 5) + 1))")).alias("content"))


@query(f"""WITH RECURSIVE {LEVELS}, uses AS (SELECT d, path, j, 5 + 4 * j AS line, 'v' || u AS name, u AS i FROM l UNION ALL SELECT d, path, j, 6 + 4 * j, 'v' || w, w FROM l WHERE w <> p),
  walk AS (SELECT uses.*, j AS lev, NULL::VARCHAR AS hit FROM uses UNION ALL
    SELECT walk.d, walk.path, walk.j, line, name, i, walk.lev - 1, CASE WHEN l.a = i THEN l.own || '.v' || i WHEN l.q = i THEN '' END
    FROM walk JOIN l ON l.d = walk.d AND l.j = walk.lev WHERE hit IS NULL),
  ends AS (SELECT path, line, name, hit AS key, NULL AS module, NULL AS imported FROM walk WHERE hit <> ''
    UNION ALL SELECT path, line, name, CASE WHEN i = d % 4 THEN path || '#v' || i END, CASE WHEN i = 4 THEN './m' || d % 3 END, CASE WHEN i = 4 THEN 'a' END
      FROM walk WHERE lev = -1 AND hit IS NULL AND (i = d % 4 OR i = 4 AND d % 2 = 0)
    UNION ALL SELECT path, 5 + 4 * j, 'f' || j, own, NULL, NULL FROM l)
  SELECT path, line::INT AS line, name, key, module, imported FROM ends""")
def scoped_names(spark, sf):
    """What each name in nested functions means: the innermost variable, function or import that binds it; none for parameters."""
    return source.Source(_nested(spark, sf)).references().select("path", "line", "name", "key", "module", "imported")


@query(f"""WITH {LEVELS} SELECT path, own AS key, 'function' AS kind, (3 + 4 * j)::INT AS start_line, (2 + 4 * k + k - j)::INT AS end_line, 'function' AS syntax FROM l
  UNION ALL SELECT path, own || '.v' || a, 'variable', 4 + 4 * j, 4 + 4 * j, 'module' FROM l UNION ALL SELECT path, own || '.g' || j, 'variable', 6 + 4 * j, 6 + 4 * j, 'function' FROM l
  UNION ALL SELECT path, path || '#v' || d % 4, 'variable', 2, 2, 'module' FROM l WHERE j = 0""")
def source_declarations(spark, sf):
    """Keys, lines and kinds of nested declarations."""
    return source.Source(_nested(spark, sf)).declarations().select("path", "key", "kind", "start_line", "end_line", "syntax")


@query(f"""WITH {LEVELS}, h AS (SELECT d, path, k, (d * 3 + i * 5) % (5 * k + 2) + 1 AS line, i FROM (SELECT *, unnest(range(3)) AS i FROM l WHERE j = 0)),
  decl AS (SELECT d, j, 0 AS own, own AS key FROM l UNION ALL SELECT d, j, 1, own || '.v' || a FROM l UNION ALL SELECT d, j, 3, own || '.g' || j FROM l),
  placed AS (SELECT h.*, CASE WHEN line <= 2 THEN -1 WHEN line <= 2 + 4 * k THEN (line - 3) // 4 ELSE 2 + 5 * k - line END AS j, CASE WHEN line BETWEEN 3 AND 2 + 4 * k THEN (line - 3) % 4 ELSE 0 END AS part FROM h),
  touched AS (SELECT placed.path, placed.i, key FROM placed JOIN decl USING (d) WHERE placed.j >= 0 AND (own = 0 AND decl.j <= placed.j OR part = 0 AND decl.j >= placed.j OR decl.j = placed.j AND own = part AND part <> 0)
    UNION SELECT path, i, path || '#v' || d % 4 FROM placed WHERE line = 2 OR line = 1 AND d % 2 = 1
    UNION SELECT placed.path, i, key FROM placed JOIN decl USING (d) WHERE line = 1 AND d % 2 = 1)
  SELECT path, i::INT AS hunk, key FROM touched""")
def touched_declarations(spark, sf):
    """Declarations that hunks of a line touch: those within the smallest node around the line, and those around it."""
    files = _nested(spark, sf)
    text = source.Source(files)
    at = F.col("d") * 3 + F.col("i") * 5
    n = table(spark, sf, "documents").select(F.col("doc_id").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    line = (F.pmod(at, 5 * (F.pmod("d", F.lit(5)) + 1) + 2) + 1).cast("int")
    h = n.select(F.pmod("d", F.lit(10)).alias("cs_id"), F.lit("new").alias("side"), F.concat(F.lit("d"), F.col("d").cast("string"), F.lit(".ts")).alias("path"), F.concat("d", F.lit(":"), "i").alias("unit_id"), F.col("i").alias("hunk_id"), line.alias("first"), line.alias("last"))
    found = analysis.UnitFacts(h, text).declared()
    return found.select(F.substring_index("symbol", "#", 1).alias("path"), F.substring_index("unit_id", ":", -1).cast("int").alias("hunk"), F.col("symbol").alias("key"))


#: Two versions of a function with up to three parameters and of an interface with up to three members.
SHAPED = """s AS (SELECT doc_id AS d, 'd' || doc_id || '.ts' AS path, unnest([0, 1]) AS side FROM documents),
  v AS (SELECT *, CASE WHEN side = 0 THEN d % 3 ELSE d % 3 + (d // 3) % 3 - CASE WHEN d % 7 = 0 THEN 1 ELSE 0 END END AS n, CASE WHEN side = 1 AND d % 5 = 0 THEN 'number' ELSE 'string' END AS r FROM s),
  p AS (SELECT v.*, list_transform(range(greatest(n, 0)), lambda i: {'type': CASE WHEN i % 2 = 0 THEN 'Map<K, V' || i || '>' ELSE '{ x: T, y?: [a, b] }' END, 'optional': side = 1 AND i >= d % 3 AND d % 2 = 0}) AS ps FROM v)"""


def _shaped(spark, sf: str) -> DataFrame:
    d, side = F.col("doc_id"), F.col("v")
    n0 = F.pmod(d, F.lit(3))
    n = F.when(side == 0, n0).otherwise(n0 + F.pmod(F.floor(d / 3), F.lit(3)) - F.when(F.pmod(d, F.lit(7)) == 0, 1).otherwise(0))
    every = F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint")), lambda i: i < n)
    mark = lambda i: F.when((side == 1) & (i >= n0) & (F.pmod(d, F.lit(2)) == 0), "?").otherwise("")
    kind = lambda i: F.when(i % 2 == 0, F.concat(F.lit("Map<K, V"), i.cast("string"), F.lit(">"))).otherwise("{ x: T,\n  y?: [a, b] }")
    field = lambda i: F.concat(F.lit("p"), i.cast("string"), mark(i), F.lit(": "), kind(i))
    result = F.when((side == 1) & (F.pmod(d, F.lit(5)) == 0), "number").otherwise("string")
    function = F.concat(F.lit("export async function h<K, V extends K>("), F.array_join(F.transform(every, field), ", "), F.lit("): "), result, F.lit(" { return '({' }\n"))
    members = F.concat(F.lit("interface I extends A, B {\n"), F.array_join(F.transform(every, lambda i: F.concat(field(i), F.when(i % 2 == 0, F.lit(";\n")).otherwise("\n"))), ""), F.lit("}\n"))
    rows = table(spark, sf, "documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("v"))
    path = F.concat(F.lit("d"), d.cast("string"), F.lit(".ts"))
    return rows.select(F.lit(1).alias("cs_id"), F.when(side == 0, "old").otherwise("new").alias("side"), path.alias("path"), F.concat(function, members).alias("content"))


@query(f"""WITH {SHAPED} SELECT path, CASE side WHEN 0 THEN 'old' ELSE 'new' END AS side, list_aggregate(list_transform(ps, lambda x: x.type || CASE WHEN x.optional THEN '?' ELSE '' END), 'string_agg', ' | ') AS parameters, r AS result,
  'K,V extends K' AS generics, 'async,export' AS modifiers, list_aggregate(list_transform(range(len(ps)), lambda i: 'p' || i || CASE WHEN ps[i + 1].optional THEN '?' ELSE '' END), 'string_agg', ',') AS members, 'extends A, B' AS heritage FROM p""")
def source_shapes(spark, sf):
    """Parameters, result, generics and modifiers of functions, and members and heritage of interfaces, from their text."""
    shapes = source.Source(_shaped(spark, sf)).shapes().select("cs_id", "path", "side", F.substring_index("key", "#", -1).alias("name"), "shape")
    h, i = (shapes.where(F.col("name") == n) for n in ("h", "I"))
    none = lambda c: F.when(c != "", c)
    parameters = F.array_join(F.transform("shape.parameters", lambda p: F.concat(p["type"], F.when(p["optional"], "?").otherwise(""))), " | ")
    members = F.array_join(F.transform(F.array_sort(F.map_entries("shape.members"), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)), lambda m: F.concat(m["key"], F.when(m["value"]["optional"], "?").otherwise(""))), ",")
    f = h.select("cs_id", "path", "side", none(parameters).alias("parameters"), "shape.result", "shape.generics", "shape.modifiers")
    return f.join(i.select("cs_id", "path", "side", none(members).alias("members"), "shape.heritage"), ["cs_id", "path", "side"]).drop("cs_id")


@query(f"""WITH {SHAPED}, b AS (SELECT o.path, o.ps AS a, n.ps AS b, o.r = n.r AS same FROM p o JOIN p n ON o.d = n.d AND o.side = 0 AND n.side = 1)
  SELECT path, same AND len(b) >= len(a) AND len(list_filter(b[len(a) + 1:], lambda x: NOT x.optional)) = 0 AS functions, len(b) >= len(a) AND len(list_filter(b[len(a) + 1:], lambda x: NOT x.optional)) = 0 AS objects FROM b""")
def source_compatibility(spark, sf):
    """Whether those who use a function or an interface can use its new version, from both texts."""
    shapes = source.Source(_shaped(spark, sf)).shapes().select("cs_id", "path", "side", F.substring_index("key", "#", -1).alias("name"), "shape").where("name IN ('h', 'I')")
    old, new = (shapes.where(F.col("side") == s).select("cs_id", "path", "name", F.col("shape").alias(s)) for s in ("old", "new"))
    fits = old.join(new, ["cs_id", "path", "name"]).withColumn("fits", source.compatible_shapes(F.col("old"), F.col("new")))
    by = lambda n: F.bool_or(F.when(F.col("name") == n, F.col("fits")))
    return fits.groupBy("cs_id", "path").agg(by("h").alias("functions"), by("I").alias("objects")).drop("cs_id")
