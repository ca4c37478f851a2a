"""Tokens, declarations, shapes, names and edges from source text, and joins by bins."""

import collections
import random
import time

import pytest
from pyspark.sql import functions as F

from weft.operators import analysis, hunks, intervals, source
from weft.session import SETTINGS

FILES = "cs_id int, side string, path string, content string"

TEXT = """import def, { hello as hi, type T } from './api';
import * as ns from "./ns";
export const active = !hi(1), other: Map<string, number> = ns.make(`a${hi(`x${def}`)} }`);
export async function one<K extends T, V>(a: string, b?: { x: number }, ...rest: string[]): Promise<void> {
  const a1 = 1, def = 2;
  for (const q of rest) { use(q, def, a1) }
  return /[/]"{/.test(a) ? inner(a) : b;
  function inner(z) { return z + a1 }
}
export default class Foo extends Bar<{}> implements Baz, Qux {
  private x: number = 3;
  static async run(p: T): Promise<T> { const y = p => p + active; return y(p) }
  get v() { return this.x }
  constructor(readonly k = 5) { super() }
}
interface Session<T> { id: string; expires?: number
  run(a: T): void }
type Al = { p: string, nested: { r: number } } & Session
enum Col { Red, Green = 2 }
const arrow = ({ m, n: o }, [w]) => m + o + w + n + active
namespace NS { export let inner = 1 }
const obj = { meth(x) { return x }, prop: active, active, fn: function () { return active } }
"""


@pytest.fixture(scope="module")
def text(spark):
    return source.Source(spark.createDataFrame([(1, "new", "a.ts", TEXT), (1, "new", "empty.ts", ""), (1, "new", "null.ts", None), (1, "new", "odd.ts", "}} ` ${ '\n ( [")], FILES))


def test_lexer_keeps_every_character():
    rng = random.Random(1)
    parts = ["`", "${", "}", "{", "'", '"', "/", "a", " ", "\n", "\\", "//", "/*", "*/", "1.5", "=>", "?.", "$", "#p", "é", "(", ")", "…"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        at = 0
        for _, token, start in source.lexed(t):
            assert token and start >= at and t[start : start + len(token)] == token, t
            gap = t[at:start]
            assert not gap.strip() or gap.lstrip().startswith(("//", "/*")), (t, gap)
            at = start + len(token)
    nested = [x for _, x, _ in source.lexed("`a${b`c${d}e`}f` / g")]
    assert nested == ["`a", "${", "b", "`c", "${", "d", "}", "e`", "}", "f`", "/", "g"]


def test_declarations(text):
    got = [(r.key.removeprefix("a.ts#"), r.kind, r.start_line, r.end_line, r.syntax) for r in text.declarations().where("path = 'a.ts'").orderBy("at").collect()]
    assert got == [
        ("active", "variable", 3, 3, "module"), ("other", "variable", 3, 3, "module"), ("one", "function", 4, 9, "function"), ("one.x", "property", 4, 4, "type"), ("one.a1", "variable", 5, 5, "module"),
        ("one.def", "variable", 5, 5, "module"), ("one.q", "variable", 6, 6, "module"), ("one.inner", "function", 8, 8, "function"), ("Foo", "class", 10, 15, "class"), ("Foo.x", "property", 11, 11, "type"),
        ("Foo.run", "method", 12, 12, "method"), ("Foo.run.y", "variable", 12, 12, "function"), ("Foo.v", "method", 13, 13, "method"), ("Foo.constructor", "method", 14, 14, "method"),
        ("Session", "interface", 16, 17, "interface"), ("Session.id", "property", 16, 16, "type"), ("Session.expires", "property", 16, 16, "type"), ("Session.run", "method", 17, 17, "method"),
        ("Al", "type", 18, 18, "type"), ("Al.p", "property", 18, 18, "type"), ("Al.nested", "property", 18, 18, "type"), ("Al.nested.r", "property", 18, 18, "type"), ("Col", "enum", 19, 19, "module"),
        ("Col.Red", "enum-member", 19, 19, "module"), ("Col.Green", "enum-member", 19, 19, "module"), ("arrow", "variable", 20, 20, "function"), ("NS", "namespace", 21, 21, "module"),
        ("NS.inner", "variable", 21, 21, "module"), ("obj", "variable", 22, 22, "module"), ("obj.meth", "method", 22, 22, "method"),
    ]


def test_shapes(text):
    got = {r.key.removeprefix("a.ts#"): r.shape for r in text.shapes().where("path = 'a.ts'").collect()}
    one = got["one"]
    assert (one.kind, one.result, one.generics, one.modifiers) == ("function", "Promise<void>", "K extends T,V", "async,export")
    assert [tuple(p) for p in one.parameters] == [("string", False, False), ("{ x: number }", True, False), ("string[]", False, True)]
    assert (got["Foo"].kind, got["Foo"].heritage, sorted(got["Foo"].members)) == ("object", "extends Bar<{}> implements Baz, Qux", ["constructor", "run", "v", "x"])
    assert got["Session"].members["expires"].optional and not got["Session"].members["id"].optional and got["Session"].generics == "T"
    assert got["Al"].kind == "other" and got["Al"].text == "|{ p: string, nested: { r: number } } & Session"
    assert got["other"].text == "export|Map<string, number>" and got["active"].text == "export|inferred"
    assert [tuple(p) for p in got["Foo.run.y"].parameters] == [("inferred", False, False)] and got["arrow"].kind == "function"


def test_names_mean_what_the_innermost_scope_says(text):
    got = [(r.line, r.name, (r.key or f"{r.module}:{r.imported}").removeprefix("a.ts#")) for r in text.references().where("path = 'a.ts'").orderBy("at").collect()]
    assert got == [
        (3, "hi", "./api:hello"), (3, "ns", "./ns:make"), (3, "hi", "./api:hello"), (3, "def", "./api:default"), (4, "T", "./api:T"), (6, "q", "one.q"), (6, "def", "one.def"), (6, "a1", "one.a1"), (7, "inner", "one.inner"),
        (8, "a1", "one.a1"), (12, "T", "./api:T"), (12, "T", "./api:T"), (12, "active", "active"), (12, "y", "Foo.run.y"), (16, "T", "./api:T"), (17, "T", "./api:T"), (18, "Session", "Session"), (20, "active", "active"),
        (22, "active", "active"), (22, "active", "active"), (22, "active", "active"),
    ]
    assert text.references().where("path <> 'a.ts'").count() == 0


API = "export function hello(name: string): string { return name; }\n"
USE = "import { hello } from './api';\nexport const result = hello('A');\n"
OVER = "export function value(input: string): string;\nexport function value(input: unknown): unknown { return input; }\n"
USE_OVER = "import { value } from './api';\nexport const result = value('A');\n"
TYPES = "export interface Session {\n  id: string;\n}\n"
USE_TYPES = "import { Session } from './types';\nexport const session: Session = { id: '1' };\n"
GROWN = {"types.ts": TYPES.replace("}\n", "  expiresAt?: number;\n}\n"), "use.ts": USE_TYPES.replace("id: '1'", "id: '1', expiresAt: 1")}
SHADOW = "import { hello } from './api';\nexport const f = (hello: number) => hello + 1;\nexport const g = 1;\n"
#: Change-sets: files before, files after, and lines of hunks where they aren't the whole file.
CASES = {
    "optional": ({"api.ts": API, "use.ts": USE}, {"api.ts": 'export function hello(name: string, suffix?: string): string { return name + (suffix ?? ""); }\n', "use.ts": USE.replace("hello('A')", "hello('A', '!')")}, {}),
    "incompatible": ({"api.ts": API, "use.ts": USE}, {"api.ts": "export function hello(name: number): string { return String(name); }\n", "use.ts": USE.replace("hello('A')", "hello(1)")}, {}),
    "overload": ({"api.ts": OVER, "use.ts": USE_OVER}, {"api.ts": OVER.replace("input: string): string;", "input: number): number;"), "use.ts": USE_OVER.replace("value('A')", "value(1)")}, {}),
    "removal": ({"api.ts": "export function legacy(): number { return 1; }\n", "use.ts": "import { legacy } from './api';\nexport const result = legacy();\n"}, {"use.ts": "export const result = 2;\n"}, {}),
    "member": ({"types.ts": TYPES, "use.ts": USE_TYPES}, GROWN, {("types.ts", "old"): [], ("types.ts", "new"): [(3, 3)]}),
    "shadow": ({"api.ts": API, "use.ts": SHADOW}, {"api.ts": API.replace("string {", "number {"), "use.ts": SHADOW.replace("hello + 1", "hello + 2")}, {("use.ts", "old"): [(2, 2)], ("use.ts", "new"): [(2, 2)]}),
    "test": ({}, {"src/model.ts": "export function expired(value: number): boolean { return value < 0; }\n", "src/model.test.ts": "import { expired as late } from './model';\nit('x', () => { late(1); });\n"}, {}),
    "binding": ({"use.ts": "import { a } from './m';\n\nfunction f() {\n  return a;\n}\n"}, {"use.ts": "import { a, b } from './m';\n\nfunction f() {\n  return b;\n}\n"}, {("use.ts", side): [(1, 1), (4, 4)] for side in ("old", "new")}),
}


@pytest.fixture(scope="module")
def edges(spark):
    """Edges of each case, all cases at once, as (source, target, kind, evidence); a hunk of several in a file is a unit of its own, named by its first line."""
    files, rows, kinds = [], [], set()
    lines = lambda t: t.count("\n")
    for cs, (before, after, ranges) in CASES.items():
        files += [(cs, side, p, t) for side, of in (("old", before), ("new", after)) for p, t in of.items()]
        for p in before.keys() | after.keys():
            if before.get(p) == after.get(p):
                continue
            for side, of in (("old", before), ("new", after)):
                own = ranges.get((p, side), [(1, lines(of[p]))]) if p in of else []
                for first, last in own:
                    unit = f"{p}:{first}" if len(own) > 1 else p
                    rows.append((cs, unit, side, p, f"{p}:{first}", first, last))
                    kinds.add((cs, unit, p if p in before else None, p if p in after else None, "modify" if p in before and p in after else "add" if p in after else "delete", "test" in p))
    text = source.Source(spark.createDataFrame(files, FILES.replace("cs_id int", "cs_id string")))
    h = spark.createDataFrame(rows, "cs_id string, unit_id string, side string, path string, hunk_id string, first int, last int")
    units = spark.createDataFrame(sorted(kinds, key=str), "cs_id string, unit_id string, old_path string, new_path string, change_kind string, is_test boolean")
    found = collections.defaultdict(set)
    for r in analysis.source_edges(units, h, text).collect():
        found[r.cs_id].add((r.src, r.dst, r.kind, r.evidence))
    return found


def test_an_optional_parameter_comes_before_those_who_use_it(edges):
    assert ("api.ts", "use.ts", "before", "compatible-signature-change") in edges["optional"] and not any(k == "must_with" for _, _, k, _ in edges["optional"])


def test_an_incompatible_signature_stays_with_those_who_use_it(edges):
    assert ("api.ts", "use.ts", "must_with", "incompatible-signature-change") in edges["incompatible"]


def test_an_overload_counts(edges):
    assert ("api.ts", "use.ts", "must_with", "incompatible-signature-change") in edges["overload"]


def test_removal_follows_migration(edges):
    assert edges["removal"] >= {("use.ts", "api.ts", "before", "removed-symbol-reference"), ("use.ts", "api.ts", "before", "removed-module-import")}


def test_a_new_optional_member_is_no_new_interface(edges):
    assert ("types.ts", "use.ts", "before", "compatible-signature-change") in edges["member"]
    assert ("types.ts", "use.ts", "before", "new-symbol-reference") not in edges["member"]


def test_a_shadowed_name_refers_to_nothing_else(edges):
    assert not any("signature" in e for *_, e in edges["shadow"])


def test_new_symbols_and_their_tests(edges):
    assert edges["test"] >= {("src/model.ts", "src/model.test.ts", k, e) for k, e in (("before", "new-symbol-reference"), ("must_with", "exclusive-new-symbol-test"), ("before", "new-module-import"))}


def test_bindings_that_come(edges):
    assert ("use.ts:1", "use.ts:4", "before", "import-binding-change") in edges["binding"]


def test_hunks_of_one_function_are_one_unit(spark):
    before = "export function one() {\n  const a = 1;\n  const b = 1;\n  return a + b;\n}\n\nexport function two() {\n  return 1;\n}\n"
    after = before.replace("a = 1", "a = 2").replace("return a + b", "return a * b").replace("return 1", "return 2")
    text = source.Source(spark.createDataFrame([(1, "old", "code.ts", before), (1, "new", "code.ts", after)], FILES))
    rows = [(1, "u", side, "code.ts", f"h{line}", line, line) for line in (2, 4, 8) for side in ("old", "new")]
    h = spark.createDataFrame(rows, "cs_id int, unit_id string, side string, path string, hunk_id string, first int, last int")
    got = {r.hunk_id: r.unit for r in analysis.merged_units(h, text).collect()}
    assert got == {"h2": "h2", "h4": "h2", "h8": "h8"}


def test_places_and_ranges(spark):
    rng = random.Random(3)
    ranges = [(k, i, a := rng.randrange(60), a + rng.choice([-1, 0, 0, 1, 3, 9, 40])) for k in (1, 2) for i in range(60)] + [(1, 99, None, 3), (1, 98, 0, 2**31), (1, 97, 2**31, 2**31)]
    places = [(rng.choice((1, 2)), i, rng.randrange(70)) for i in range(120)] + [(1, 500, None), (1, 501, 2**31), (1, 502, 0)]
    r = spark.createDataFrame(ranges, "k int, r int, start long, end long")
    got = collections.Counter((x.p, x.r) for x in intervals.stabbed(spark.createDataFrame(places, "k int, p int, at long"), r, ["k"], "at").collect())
    assert got == collections.Counter((p, i) for k, p, x in places for j, i, a, b in ranges if k == j and None not in (x, a) and a <= x <= b)
    other = [(k, 1000 + i, a := rng.randrange(60), a + rng.choice([0, 1, 3, 9, 40])) for k in (1, 2) for i in range(60)]
    o = spark.createDataFrame(other, "k int, o int, first long, last long")
    pairs = collections.Counter((x.o, x.r) for x in intervals.nested_either_way(o, r, ["k"], ("first", "last"), ("start", "end")).collect())
    assert pairs == collections.Counter((i, m) for k, i, a, b in other for j, m, c, d in ranges if k == j and c is not None and c <= d and (c <= a and b <= d or a <= c and d <= b))


def test_one_file_of_very_many_hunks_and_nodes(spark):
    n = 100_000
    nodes = spark.range(n).select(F.lit(1).alias("cs_id"), F.lit("f").alias("file"), F.col("id").alias("node_id"), (10 * F.col("id")).alias("start"), (10 * F.col("id") + 9).alias("end"), F.lit(1).alias("depth"))
    nodes = nodes.unionByName(spark.range(1000).select(F.lit(1).alias("cs_id"), F.lit("f").alias("file"), (n + F.col("id")).alias("node_id"), (1000 * F.col("id")).alias("start"), (1000 * F.col("id") + 999).alias("end"), F.lit(0).alias("depth")))
    at = spark.range(n).select(F.lit(1).alias("cs_id"), F.lit("f").alias("file"), F.col("id").alias("hunk_id"), (10 * F.col("id") + F.col("id") % 8).alias("first"), (10 * F.col("id") + F.col("id") % 8 + 3).alias("last"))
    began = time.time()
    found = hunks.smallest_containing(at, nodes)
    wrong = found.where(F.col("node_id") != F.when(F.col("hunk_id") % 8 <= 6, F.col("hunk_id")).otherwise(n + F.floor(F.col("hunk_id") / 100)))
    assert (found.count(), wrong.count()) == (n - sum(1 for i in range(n) if i % 8 == 7 and (i % 100) == 99), 0)
    assert time.time() - began < 120


def test_tables_of_a_text_stay_where_their_file_is(spark, monkeypatch):
    """No table of a text is dealt out behind its tokens, and buckets follow the size of the input."""
    monkeypatch.setattr(source, "BUCKET_CHARS", 2 * len(TEXT))
    rows = [(i % 2, side, f"{i}.ts", TEXT) for i in range(12) for side in ("old", "new")]
    conf = SETTINGS | {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        text = source.Source(spark.createDataFrame(rows, FILES))
        assert text.buckets == 12
        for found in (text.declarations(), text.shapes(), text.references(), text.uses(), text.bindings(), text.tokens):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan, plan
        one = source.Source(spark.createDataFrame(rows[:1], FILES))
        assert text.references().count() == 24 * one.references().count() > 0
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_no_table_of_a_text_goes_through_the_driver(spark):
    """Whatever their files' size says, tables are joined where they lie."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        text = source.Source(spark.createDataFrame([(i % 2, side, f"{i}.ts", TEXT) for i in range(12) for side in ("old", "new")], FILES))
        h = text.files.select("cs_id", "side", "path", F.lit("u").alias("unit_id"), F.lit("h").alias("hunk_id"), F.lit(3).alias("first"), F.lit(4).alias("last"))
        of_units = analysis.UnitFacts(h, text)
        shapes = text.shapes()
        twice = shapes.join(shapes.select(*source.KEY, "key", F.col("line").alias("again")), [*source.KEY, "key"])
        for found in (text.declarations(), shapes, twice, text.references(), text.bindings(), text._bodies(), text._declared(), text._keyed(), text._bound(), of_units.declared(), analysis.hunk_nodes(h, text)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Broadcast" not in plan, plan
    finally:
        for k in SETTINGS:
            spark.conf.unset(k)
