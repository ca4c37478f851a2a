"""Source text of many files as tables: tokens, brackets, statements, declarations with keys and shapes, scopes, and names resolved to what binds them.

files: cs_id, side ('old' or 'new'), path, content. A lexer with a stack (template texts hold code, which holds templates) turns each file into
token rows; all else is windows, groupings and joins over those:

* the depth of brackets is a running sum; a token lies inside of the last bracket opened one level above it;
* the tokens between two brackets, without what lies deeper, are cut into statements and, at commas, into pieces. Nested brackets show as empty
  pairs there, so regular expressions can read a statement: ``export function f ( ) : T { }``;
* scopes are brackets and the bodies of arrow functions. The chains of scopes around each come from pointer doubling, so rounds grow with the
  logarithm of the depth; keys ``path#A.b`` are the names that own the scopes of a chain;
* a name means what the innermost scope of its chain that binds it says: an equi-join on (scope, name), and the nearest hit.

There is no type checker: ``var`` binds in its block, a destructuring pattern binds its first level, members are no bindings, JSX isn't read. Null and empty
texts have no rows. Files are bounded (``maxFileBytes`` of the settings); windows go over one file's tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.operators import facts
from weft.operators.edgerules import compatible_functions, compatible_objects
from weft.session import bucketed

KEY = ["cs_id", "side", "path"]
#: What the tables of a text are dealt by: both sides of a file lie together.
PLACE = ["cs_id", "path"]
#: Characters of text in a bucket, about 300,000 tokens: what the sorts of a task hold stays the same at any size of the input.
BUCKET_CHARS = 1 << 20
TOP = -1

# Words of the language.
CONTROL = ["if", "while", "for", "switch", "with"]
KEYWORDS = [
    *CONTROL, "function", "class", "interface", "enum", "const", "let", "var", "export", "import", "default", "extends", "implements", "new", "typeof", "instanceof", "in", "return",
    "throw", "case", "else", "try", "catch", "finally", "do", "break", "continue", "delete", "void", "this", "super", "null", "true", "false", "yield", "await",
]
BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "do", "else", "instanceof", "await", "yield"}
#: What goes on with the statement before it, and behind what a statement goes on.
GOES_ON = [".", "?.", ",", ";", ")", "]", "}", "=", "=>", "+", "-", "*", "/", "%", "&", "|", "^", "&&", "||", "??", "?", ":", "<", ">", "==", "===", "!=", "!==", "<=", ">=", "(", "[", "{", "else", "catch", "finally", "from", "as", "in", "of", "instanceof", "extends", "implements", "satisfies"]
OPEN_END = [".", "?.", ",", "(", "[", "{", "${", "=", "=>", "+", "-", "*", "/", "%", "&", "|", "^", "&&", "||", "??", "?", ":", "<", "==", "===", "!=", "!==", "<=", ">=", "!", "...", "@", "export", "default", "import", "from", "as", "const", "let", "var", "function", "class", "interface", "enum", "extends", "implements", "new", "typeof", "in", "of", "instanceof", "case", "throw", "abstract", "declare", "satisfies"]

_LEX = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<word>[#@]?[^\W\d][\w$‌‍]*|\#?[$][\w$]*)|(?P<number>\d[\w.]*|\.\d\w*)"""
    r"""|(?P<string>"(?:[^"\\\n]|\\[\s\S])*"?|'(?:[^'\\\n]|\\[\s\S])*'?)|(?P<tick>`)|(?P<punct>=>|\.\.\.|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|[=!]==?|<=|\+\+|--|[-+*/%&|^]=|[\s\S])"""
)
_WORD = re.compile(r"[$\w]")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")


def lexed(text: str) -> Iterator[tuple[str, str, int]]:
    """(kind, text, start) of each token: word, number, string, template, regex or punct. ``${`` and its ``}`` are tokens of their own."""
    at, last, stack = 0, ("punct", "("), []
    while at < len(text):
        m = _LEX.match(text, at)
        kind, token = m.lastgroup, m[0]
        if kind == "tick" or (token == "}" and stack and stack.pop() == "${"):
            if kind != "tick":
                yield "punct", "}", at
            body = _TEMPLATE.match(text, at + 1)
            end = body.end() + (text[body.end() : body.end() + 1] == "`")
            begin = at if kind == "tick" else at + 1
            if end > begin:
                yield "template", text[begin:end], begin
            if text[end : end + 2] == "${" and end == body.end():
                yield "punct", "${", end
                stack.append("${")
                end += 2
            at, last = max(end, at + 1), ("template", "") if not stack or stack[-1] != "${" else ("punct", "${")
            continue
        if token == "{":
            stack.append("{")
        before_regex = last[0] == "punct" and last[1] not in (")", "]", "}") or last[1] in BEFORE_REGEX
        if kind == "punct" and token[0] == "/" and before_regex and (r := _REGEX.match(text, at)):
            kind, token = "regex", r[0]
        if kind != "skip":
            yield kind, token, at
            last = kind, token
        at += len(token)


def in_place(rows: DataFrame) -> DataFrame:
    """``rows``, joined by merging. Their files are small by compression alone, so Spark would take whole tables through the driver to send them to all tasks (23 MB where the
    limit was 256 KB); dealt as they are, rows meet without that. Needed again behind a join or a union, where Spark forgets it."""
    return rows.hint("merge")


def tokens(files: DataFrame) -> DataFrame:
    """A row a token: cs_id, side, path, at (from 0), kind, text, start and stop (characters), line (from 1)."""
    kind = files.schema["cs_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, content in enumerate(batch.column("content").to_pylist()):
                found = list(lexed(content or ""))
                if not found:
                    continue
                line, seen, lines = 1, 0, []
                for _, _, start in found:
                    line += content.count("\n", seen, start)
                    seen = start
                    lines.append(line)
                own = [batch.column(k).take(pa.array([i] * len(found))) for k in KEY]
                start = [s for _, _, s in found]
                columns = (range(len(found)), [k for k, _, _ in found], [t for _, t, _ in found], start, [s + len(t) for _, t, s in found], lines)
                types = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], [*KEY, "at", "kind", "text", "start", "stop", "line"])

    return files.select(*KEY, "content").mapInArrow(rows, f"cs_id {kind}, side string, path string, at int, kind string, text string, start int, stop int, line int")


def statements(found: DataFrame) -> DataFrame:
    """Tokens with depth, inside (the bracket around, -1 at the top), around (its text), match (of an opening bracket), item and piece (statement and
    part between commas among the tokens right inside of a bracket), prev and next (texts beside it there), scope."""
    mark = F.col("kind") == "punct"
    opens, closes = mark & F.col("text").isin("(", "[", "{", "${"), mark & F.col("text").isin(")", "]", "}")
    by = W.partitionBy(*KEY).orderBy("at")
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    rows = found.withColumns({"opens": opens, "closes": closes, "depth": F.sum(step).over(by.rowsBetween(W.unboundedPreceding, 0)) - F.when(opens, 1).otherwise(0)})
    # an opening bracket marks the level within it
    level = F.array(F.struct(F.col("depth").alias("level"), F.lit(False).alias("mark")), F.when(F.col("opens"), F.struct((F.col("depth") + 1).alias("level"), F.lit(True).alias("mark"))))
    rows = rows.select("*", F.explode(F.array_compact(level)).alias("_l")).select("*", "_l.level", "_l.mark").drop("_l")
    at_level = W.partitionBy(*KEY, "level").orderBy("at", "mark")
    around = F.last(F.when(F.col("mark"), F.struct("at", "text")), ignorenulls=True).over(at_level.rowsBetween(W.unboundedPreceding, 0))
    match = F.lead(F.when(F.col("closes"), F.col("at"))).over(at_level)  # all between lies deeper
    rows = rows.withColumns({"_around": F.when(F.col("level") > 0, around), "match": F.when(F.col("opens") & ~F.col("mark"), match)}).where("NOT mark")
    rows = rows.withColumns({"inside": F.coalesce("_around.at", F.lit(TOP)), "around": F.col("_around.text")}).drop("_around", "level", "mark")

    # statements, pieces and bodies of arrows follow from running sums and last places over one order, so that tokens are sorted once for all of them
    beside = W.partitionBy(*KEY, "inside").orderBy("at")
    to_here, before = beside.rowsBetween(W.unboundedPreceding, 0), beside.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"prev": F.lag("text").over(beside), "next": F.lead("text").over(beside), "_prev": F.lag(F.struct("line", "stop", "kind")).over(beside)})
    adjoins = F.col("start") == F.col("_prev.stop")  # an angle bracket of types stands next to what it belongs to
    angle = F.when((F.col("text") == "<") & adjoins & (F.col("_prev.kind") == "word"), 1).when((F.col("text") == ">") & adjoins, -1).otherwise(0)
    rows = rows.withColumn("_open", F.sum(angle).over(to_here))
    since = F.last(F.when(F.col("text") == ";", F.col("_open")), ignorenulls=True).over(to_here)  # what is open counts from the last semicolon on
    newline = (F.col("line") > F.col("_prev.line")) & ~(F.col("prev").isin(OPEN_END) & F.col("_prev.kind").isin("punct", "word"))
    begins = F.coalesce((F.col("prev") == ";") | (((F.col("prev") == "}") | newline) & ~F.col("text").isin(GOES_ON)), F.lit(False)) & (F.col("around").isNull() | (F.col("around") == "{"))
    rows = rows.withColumns({"_angle": F.col("_open") - F.coalesce(since, F.lit(0)), "_begins": begins})
    comma = mark & (F.col("text") == ",") & (F.col("_angle") <= 0)
    rows = rows.withColumns({"item": F.sum(F.col("_begins").cast("int")).over(to_here), "_commas": F.coalesce(F.sum(comma.cast("int")).over(before), F.lit(0)), "_cut": F.col("_begins") | F.coalesce(F.lag(comma).over(beside), F.lit(False))})
    of_item = F.last(F.when(F.col("_begins"), F.col("_commas")), ignorenulls=True).over(to_here)
    of_piece = F.last(F.when(F.col("_cut"), F.col("at")), ignorenulls=True).over(to_here)
    arrow = F.when((F.col("text") == "=>") & F.coalesce(F.col("next") != "{", F.lit(True)), F.col("at"))
    rows = rows.withColumns({"piece": F.col("_commas") - F.coalesce(of_item, F.lit(0)), "_own": F.last(arrow, ignorenulls=True).over(before), "_from": F.coalesce(of_piece, F.lit(TOP))})
    own = F.when(F.col("_own") >= F.col("_from"), F.col("_own"))
    return rows.withColumn("scope", F.coalesce(own, "inside")).drop("_prev", "_open", "_angle", "_begins", "_commas", "_cut", "_own", "_from")


def _forms(rows: DataFrame, *by: str) -> DataFrame:
    """Statements, or their pieces, as one row each: parts (tokens in order) and form (their texts, spaced; literals empty)."""
    plain = F.when(F.col("kind") == "string", '""').when(F.col("kind") == "template", "``").when(F.col("kind") == "regex", "//").otherwise(F.col("text"))
    part = F.struct("at", "kind", "text", plain.alias("plain"), "start", "stop", "line", "match", "scope")
    out = rows.groupBy(*KEY, "inside", "around", *by).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return out.withColumn("form", F.array_join(F.transform("parts", lambda p: p["plain"]), " "))


_N = r"""(?:[^\s.,;:?!<>(){}\[\]=+*/%&|^~@"'`-]+)"""
_MODIFIERS = "(?:(?:export|default|declare|abstract|async) )*"
_MEMBER_MODIFIERS = r"(?:(?:public|private|protected|static|readonly|override|abstract|declare|async|accessor)(?= (?!\(|:|=|\?|;|,|<|$)) )*"
_VARIABLE = rf"^{_MODIFIERS}(?:const|let|var|using) (?!enum )"
_ITEM = rf"^({_MODIFIERS}(?:const (?=enum ))?)(function|class|interface|type|enum|namespace|module)((?: \*)?)(?: ({_N}|\"\"))?(?= |$)"
_MEMBER = rf"^({_MEMBER_MODIFIERS})((?:(?:get|set) (?={_N}|\"\"))?(?:\* )?)({_N}|\"\")( \?| !)?(?=(?: (?:\(|<|:|=|;|,).*)?$)"


def _count(prefix: Column) -> Column:
    """How many tokens a prefix that ends with a space has."""
    return F.length(F.regexp_replace(prefix, "[^ ]", ""))


def _index(parts: Column, text: str, start: Column | int = 0) -> Column:
    """The first place from ``start`` on where a part has this text, -1 if none."""
    places = F.filter(F.transform(parts, lambda p, i: F.when((p["plain"] == text) & (i >= start), i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(places, F.lit(0)), F.lit(-1))


def _last_index(parts: Column, text: str) -> Column:
    places = F.filter(F.transform(parts, lambda p, i: F.when(p["plain"] == text, i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(places, F.size(places) - 1), F.lit(-1))


def _without_end(parts: Column) -> Column:
    """Without the mark that ends it."""
    last = F.get(parts, F.size(parts) - 1)["plain"]
    return F.when(last.isin(";", ","), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


class Source:
    """The tables of some files' texts. Each is written once to the shared folder, as the later ones read it many times."""

    def __init__(self, files: DataFrame) -> None:
        files = files.select(*KEY, "content")
        chars = files.agg(F.sum(F.length("content"))).first()[0] or 0
        spark = files.sparkSession
        least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # more tasks than that only cost the driver their records
        self.buckets = max(least, -(-chars // BUCKET_CHARS))
        dealt = files.repartition(self.buckets, *PLACE)
        self.files = self.kept(dealt, "files")
        self.tokens = self.kept(statements(self.kept(tokens(dealt), "read")), "tokens")
        items = _forms(self.tokens, "item")
        head = F.first("form").over(W.partitionBy(*KEY, "inside", "item").orderBy("piece").rowsBetween(W.unboundedPreceding, 0))
        self.pieces = self.kept(_forms(self.tokens, "item", "piece").withColumn("head", head).withColumn("parts", _without_end(F.col("parts"))), "pieces")
        self.items = self.kept(items.where("around IS NULL OR around = '{'").withColumn("parts", _without_end(F.col("parts"))), "items")
        self.chains = self._chains()
        self.bodies = self.kept(self._bodies(), "bodies")
        self.declared = self.kept(self._declared(), "declared")
        self.keyed = self.kept(self._keyed(), "keyed")
        self.bound = self.kept(self._bound(), "bound")

    def kept(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` written once, dealt as all tables of these texts are, so that joins of them and windows over them leave rows where they are."""
        return in_place(bucketed(rows, f"source_{name}", PLACE, self.buckets))

    # -- brackets

    def _chains(self) -> DataFrame:
        """(scope, chain): each scope followed by all those around it, innermost first; the top is -1. Each round doubles how far chains reach."""
        rows = self.tokens
        arrow = (F.col("text") == "=>") & (F.col("kind") == "punct") & F.coalesce(F.col("next") != "{", F.lit(True))
        every = rows.where(F.col("opens") | arrow).select(*KEY, F.col("at").alias("scope"), F.array(F.col("at"), "scope").alias("chain"))
        found = self.kept(every.unionByName(rows.select(*KEY).distinct().select(*KEY, F.lit(TOP).alias("scope"), F.array(F.lit(TOP)).alias("chain"))), "chains")
        while found.where(F.element_at("chain", -1) != TOP).limit(1).count():
            upper = found.select(*KEY, F.col("scope").alias("last"), F.col("chain").alias("more"))
            found = found.withColumn("last", F.element_at("chain", -1)).join(upper, [*KEY, "last"])
            found = self.kept(found.select(*KEY, "scope", F.concat("chain", F.expr("slice(more, 2, size(more))")).alias("chain")), "chains")
        return found

    def _bodies(self) -> DataFrame:
        """Every ``{`` with the kind of what it holds: block, class, interface, enum, type or object."""
        braces = self.tokens.where("opens AND text = '{'").select(*KEY, "at", "inside", "item", "piece", "prev", "around")
        kind = F.regexp_extract("form", _ITEM, 2)
        body = F.get("parts", _last_index(F.col("parts"), "{"))["at"]
        literal = F.get("parts", _index(F.col("parts"), "=") + 1)
        of_items = self.items.select(*KEY, "inside", "item", "form", kind.alias("kind"), F.when(kind == "type", F.when(literal["plain"] == "{", literal["at"])).otherwise(body).alias("at"))
        holds = F.when(F.col("kind").isin("class", "interface", "enum", "type"), F.col("kind")).when(F.col("kind") != "", "block")
        own = of_items.where("kind <> '' AND at IS NOT NULL").select(*KEY, "at", holds.alias("by_item"))
        method = F.col("form").rlike(rf"^{_MEMBER_MODIFIERS}(?:(?:get|set) )?(?:\* )?(?:{_N}|\"\")(?: <.*>)? \( \)(?: : .*)? \{{ \}}(?: [;,])?$")
        typed = F.col("head").rlike(_VARIABLE) & ~F.col("form").contains(" = ")
        by_piece = self.pieces.select(*KEY, "inside", "item", "piece", typed.alias("typed"), F.when(method, F.get("parts", _last_index(F.col("parts"), "{"))["at"]).alias("block"))
        rows = braces.join(own, [*KEY, "at"], "left").join(by_piece, [*KEY, "inside", "item", "piece"], "left")
        after = F.col("prev")
        kind = F.coalesce("by_item", F.when(F.col("block") == F.col("at"), "block").when(after.isNull() | after.isin("else", "try", "do", "finally", ")", "=>", ";", "}"), "block")
                          .when((after == ":") & ((F.col("around") == "(") | F.coalesce("typed", F.lit(False))), "type").when(after != ":", "object"))
        rows = rows.select(*KEY, "at", "inside", kind.alias("holds"))
        # behind a colon: a type where the next bracket around that is known holds members, else an object
        sure = rows.where("holds IS NOT NULL").select(*KEY, F.col("at").alias("upper"), F.col("holds").alias("upper_holds"))
        chain = self.chains.select(*KEY, F.col("scope").alias("at"), F.posexplode("chain").alias("far", "upper"))
        near = rows.where("holds IS NULL").select(*KEY, "at").join(chain, [*KEY, "at"]).join(in_place(sure), [*KEY, "upper"]).groupBy(*KEY, "at").agg(F.min_by("upper_holds", "far").alias("near"))
        typed = F.when(F.col("near").isin("class", "interface", "type"), "type").otherwise("object")
        return rows.join(in_place(near), [*KEY, "at"], "left").select(*KEY, "at", "inside", F.coalesce("holds", typed).alias("holds"))

    # -- declarations

    def _declared(self) -> DataFrame:
        """Named declarations: name, kind, at (of the name), scope, inside, item, piece (null where it is the whole statement), modifiers, parts, name_at (place among parts), member."""
        holds = self.bodies.select(*KEY, F.col("at").alias("inside"), "holds")
        top = F.col("around").isNull() | F.coalesce(F.col("holds") == "block", F.lit(False))
        group = lambda p, n: F.regexp_extract("form", p, n)
        named = self.items.join(holds, [*KEY, "inside"], "left").where(top).withColumns({"kind": group(_ITEM, 2), "modifiers": group(_ITEM, 1), "star": group(_ITEM, 3), "written": group(_ITEM, 4)}).where("kind <> ''")
        named = named.where((F.col("kind") != "type") | F.col("form").rlike(rf"^{_MODIFIERS}type {_N} [=<]"))
        default = (F.col("written") == "") & F.col("modifiers").contains("default")
        at = _count(F.concat("modifiers", F.lit(" "), "star")) + F.when(default, 0).otherwise(1) - F.when(F.col("star") == "", 1).otherwise(1)
        named = named.withColumns({"name_at": at, "default": default}).where("default OR written <> ''")
        of_items = named.select(*KEY, "inside", "item", F.lit(None).cast("long").alias("piece"), "kind", "modifiers", "parts", "name_at", "default", F.lit(False).alias("member"))

        declarator = F.when(F.col("piece") == 0, F.regexp_replace("form", _VARIABLE, "")).otherwise(F.col("form"))
        variables = self.pieces.where(F.col("head").rlike(_VARIABLE)).withColumn("rest", declarator).where(F.col("rest").rlike(rf"^{_N}(?: (?:=|:|!|of|in|;|,)|$)"))
        prefix = F.when(F.col("piece") == 0, F.regexp_extract("form", f"({_VARIABLE})", 1)).otherwise("")
        modifiers = F.regexp_extract("head", f"^({_MODIFIERS})", 1)
        of_variables = variables.select(*KEY, "inside", "item", "piece", F.lit("variable").alias("kind"), modifiers.alias("modifiers"), "parts", _count(prefix).alias("name_at"), F.lit(False).alias("default"), F.lit(False).alias("member"))

        members = self.pieces.join(holds.where("holds <> 'block'"), [*KEY, "inside"]).withColumns({"modifiers": group(_MEMBER, 1), "accessor": group(_MEMBER, 2), "written": group(_MEMBER, 3)}).where("written <> ''")
        calls = F.col("form").rlike(rf"^{_MEMBER_MODIFIERS}(?:(?:get|set) )?(?:\* )?(?:{_N}|\"\")(?: [?!])?(?: <.*>)? \(")
        kind = F.when(F.col("holds") == "enum", "enum-member").when(calls, "method").otherwise("property")
        members = members.withColumn("kind", kind).where("holds <> 'object' OR (kind = 'method' AND form LIKE '%{ }%')")
        of_members = members.select(*KEY, "inside", "item", "piece", "kind", F.concat("modifiers", F.regexp_extract("accessor", "(get |set )?", 1)).alias("modifiers"), "parts", _count(F.concat("modifiers", "accessor")).alias("name_at"), F.lit(False).alias("default"), F.lit(True).alias("member"))

        found = reduce(DataFrame.unionByName, [of_items.withColumn("piece", F.col("piece").cast("long")), of_variables.withColumn("piece", F.col("piece").cast("long")), of_members.withColumn("piece", F.col("piece").cast("long"))])
        token = F.get("parts", "name_at")
        text = F.when(token["kind"] == "string", F.regexp_replace(token["text"], "^[\"']|[\"']$", "")).otherwise(token["text"])
        return found.select(*KEY, "inside", "item", "piece", "kind", F.trim("modifiers").alias("modifiers"), "parts", "name_at", "member", F.when(F.col("default"), "default").otherwise(text).alias("name"), token["at"].alias("at"), token["scope"].alias("scope"))

    def _owners(self) -> DataFrame:
        """(scope, name) of the brackets that stand in a declaration."""
        rows = self.tokens.where("opens").select(*KEY, F.col("at").alias("bracket"), "inside", "item", F.col("piece").alias("_piece"))
        d = self.declared.select(*KEY, "inside", "item", "piece", "name", "at")
        return rows.join(d, [*KEY, "inside", "item"]).where("(piece IS NULL OR piece = _piece) AND at <= bracket").select(*KEY, F.col("bracket").alias("upper"), F.col("name").alias("owner"))

    def declarations(self) -> DataFrame:
        """key (``path#A.b``), name, kind, at, scope, start and stop (characters), start_line and end_line, syntax (kind of unit), of all named declarations."""
        return self.keyed

    def _keyed(self) -> DataFrame:
        chain = self.declared.select(*KEY, "at", "scope").join(self.chains, [*KEY, "scope"]).select(*KEY, "at", F.posexplode("chain").alias("far", "upper"))
        path = chain.join(in_place(self._owners()), [*KEY, "upper"]).groupBy(*KEY, "at").agg(F.array_sort(F.collect_list(F.struct((-F.col("far")).alias("far"), "owner"))).alias("owners"))
        rows = self.declared.join(path, [*KEY, "at"], "left")
        names = F.concat(F.coalesce(F.transform("owners", lambda o: o["owner"]), F.array().cast("array<string>")), F.array("name"))
        first = F.when(F.col("kind") == "variable", F.get("parts", "name_at")).otherwise(F.get("parts", F.lit(0)))
        last = F.get("parts", F.size("parts") - 1)
        value = F.get("parts", _index(F.col("parts"), "=") + 1)["plain"]
        is_function = (F.col("kind") == "variable") & ((value == "function") | (_index(F.col("parts"), "=>") >= 0) | (value == "async"))
        syntax = F.when((F.col("kind") == "function") | is_function, "function").when(F.col("kind").isin("class", "interface", "method"), F.col("kind")).when(F.col("kind").isin("type", "property"), "type").otherwise("module")
        return rows.select(*KEY, F.concat("path", F.lit("#"), F.array_join(names, ".")).alias("key"), "name", "kind", "at", "scope", first["start"].alias("start"), last["stop"].alias("stop"), first["line"].alias("start_line"), last["line"].alias("end_line"), syntax.alias("syntax"))

    def shapes(self) -> DataFrame:
        """key, at, line, shape and signature of all declarations. shape: kind (function, object or other) and what compatible_functions and compatible_objects take, or a text."""
        d = self.declared.join(self.declarations().select(*KEY, "at", "key", F.col("start_line").alias("line")), [*KEY, "at"])
        d = d.withColumns({"modifiers": F.array_join(F.array_sort(F.array_remove(F.split("modifiers", " "), "")), ",")})
        parts, name_at = F.col("parts"), F.col("name_at")
        d = d.withColumn("form", F.array_join(F.transform(parts, lambda p: p["plain"]), " "))
        # a function value: behind the equals sign
        begin = F.when(F.col("kind").isin("variable", "property"), F.greatest(_index(parts, "="), F.lit(-1))).otherwise(name_at)
        paren = _index(parts, "(", F.greatest(begin, F.lit(0)))
        leading = F.array_join(F.transform(F.slice(parts, begin + 2, F.greatest(paren - begin - 1, F.lit(0))), lambda p: p["plain"]), " ")
        called = F.col("kind").isin("function", "method") | (F.col("kind").isin("variable") & (begin >= 0) & leading.rlike(rf"^(?:async ?)?(?:function(?: \*)?(?: {_N})?)?(?: ?<.*>)?$") & ((_index(parts, "=>", paren) >= 0) | leading.contains("function")))
        d = d.withColumns({"calls": called & (paren >= 0), "paren": F.get(parts, paren)["at"], "paren_at": paren, "bare": F.col("form").rlike(rf"= (?:async )?{_N} =>")})
        body = F.when(F.col("calls"), F.when(_index(parts, "=>", F.col("paren_at")) >= 0, _index(parts, "=>", F.col("paren_at"))).when(F.get(parts, F.size(parts) - 1)["plain"] == "}", _last_index(parts, "{")).otherwise(F.size(parts)))
        colon = F.when(F.get(parts, F.col("paren_at") + 2)["plain"] == ":", F.col("paren_at") + 3)
        d = d.withColumns({"result_from": F.get(parts, colon)["start"], "result_to": F.get(parts, body - 1)["stop"]})
        angle = F.when(F.get(parts, name_at + 1)["plain"] == "<", name_at + 2)
        close = _last_before(parts, ">", F.when(F.col("calls"), F.col("paren_at")).otherwise(F.greatest(_index(parts, "{"), _index(parts, "="))))
        d = d.withColumns({"generic_from": F.get(parts, angle)["start"], "generic_to": F.get(parts, close - 1)["stop"]})
        plain_end = F.when(_index(parts, "=", name_at) >= 0, _index(parts, "=", name_at)).otherwise(F.size(parts))
        type_at = _index(parts, ":", name_at)
        typed = (type_at >= 0) & (type_at < plain_end)
        d = d.withColumns({"type_from": F.when(typed, F.get(parts, type_at + 1)["start"]), "type_to": F.when(typed, F.get(parts, plain_end - 1)["stop"])})
        d = d.withColumns({"alias_from": F.when(F.col("kind") == "type", F.get(parts, _index(parts, "=") + 1)["start"]), "whole_from": F.get(parts, F.lit(0))["start"], "whole_to": F.get(parts, F.size(parts) - 1)["stop"]})
        heirs = F.filter(F.transform(parts, lambda p, i: F.when(p["plain"].isin("extends", "implements") & (i > name_at), i)), lambda i: i.isNotNull())
        heir = F.when(F.size(heirs) > 0, F.array_min(heirs))
        d = d.withColumns({"heir_from": F.get(parts, heir)["start"], "heir_to": F.get(parts, _last_index(parts, "{") - 1)["stop"], "optional": F.get(parts, name_at + 1)["plain"] == "?", "body": F.when(F.col("kind").isin("class", "interface"), F.get(parts, _last_index(parts, "{"))["at"]).when((F.col("kind") == "type") & (F.get(parts, F.size(parts) - 2)["plain"] == "{") & (_index(parts, "=") + 3 == F.size(parts)), F.get(parts, F.size(parts) - 2)["at"])})

        parameters = self.parameters().groupBy(*KEY, "paren").agg(F.array_sort(F.collect_list(F.struct("piece", F.struct("type", "optional", "rest").alias("own")))).alias("_p"))
        d = d.join(in_place(parameters), [*KEY, "paren"], "left").join(self.files, KEY)
        text = lambda a, b: _text(F.col("content"), F.col(a), F.col(b))
        modifiers = F.col("modifiers")
        none = F.lit(None)
        parameter, member = "array<struct<type:string,optional:boolean,rest:boolean>>", "map<string,struct<signature:string,optional:boolean>>"

        def shape(kind: str, **fields: Column) -> Column:
            every = {"parameters": parameter, "result": "string", "generics": "string", "modifiers": "string", "heritage": "string", "members": member, "text": "string"}
            return F.struct(F.lit(kind).alias("kind"), *[fields.get(n, none).cast(t).alias(n) for n, t in every.items()])

        generics = F.coalesce(F.regexp_replace(text("generic_from", "generic_to"), ", ", ","), F.lit(""))
        function = shape("function", parameters=F.coalesce(F.transform("_p", lambda p: p["own"]), F.array().cast(parameter)), result=F.coalesce(text("result_from", "result_to"), F.lit("inferred")), generics=generics, modifiers=modifiers)
        one = F.array(F.struct(F.lit("inferred").alias("type"), F.lit(False).alias("optional"), F.lit(False).alias("rest"))).cast(parameter)
        bare = shape("function", parameters=one, result=F.lit("inferred"), generics=F.lit(""), modifiers=modifiers)
        kept = F.coalesce(text("type_from", "type_to"), F.lit("inferred"))
        other = shape("other", text=F.concat(modifiers, F.lit("|"), F.when(F.col("kind").isin("variable", "property"), F.concat(kept, F.when(F.col("optional"), "?").otherwise("")))
                                             .when(F.col("kind") == "type", text("alias_from", "whole_to")).otherwise(text("whole_from", "whole_to"))))
        d = self.kept(d.select(*KEY, "inside", "at", "key", "name", "kind", "line", "body", "member", F.coalesce("optional", F.lit(False)).alias("optional"), modifiers.alias("modifiers"), generics.alias("generics"),
                                 F.coalesce(text("heir_from", "heir_to"), F.lit("")).alias("heritage"), F.when(F.col("calls"), function).when(F.col("bare") & (F.col("kind") == "variable"), bare).otherwise(other).alias("own")), "shapes")
        entry = F.struct("name", F.struct(F.to_json("own").alias("signature"), "optional").alias("value"))
        last = d.where("member").groupBy(*KEY, "inside", "name").agg(F.max_by(entry, "at").alias("entry"))
        held = last.groupBy(*KEY, F.col("inside").alias("body")).agg(F.map_from_entries(F.array_sort(F.collect_list("entry"))).alias("members"))
        d = d.join(held, [*KEY, "body"], "left")
        is_object = F.col("kind").isin("class", "interface") | ((F.col("kind") == "type") & F.col("body").isNotNull())
        full = shape("object", members=F.coalesce("members", F.create_map().cast(member)), heritage=F.col("heritage"), generics=F.col("generics"), modifiers=modifiers)
        d = d.withColumn("shape", F.when(is_object, full).otherwise(F.col("own")))
        return in_place(d.select(*KEY, "key", "at", "line", "shape", F.to_json("shape").alias("signature")))

    def parameters(self) -> DataFrame:
        """paren, piece, name (null for a pattern), type, optional, rest, at of each piece between round brackets, cut at depth-one commas."""
        rows = self.pieces.where("around = '(' AND size(parts) > 0").withColumn("n", F.when(F.col("form").startswith("..."), 1).otherwise(0) + _count(F.regexp_extract("form", r"^(?:\.\.\. )?((?:(?:public|private|protected|readonly) (?=[^:?=,]))*)", 1)))
        parts = F.col("parts")
        token = F.get(parts, "n")
        value = _index(parts, "=")
        end = F.when(value >= 0, value).otherwise(F.size(parts))
        colon = _index(parts, ":")
        typed = (colon >= 0) & (colon < end)
        rows = rows.join(self.files, KEY)
        kind = F.when(typed, _text(F.col("content"), F.get(parts, colon + 1)["start"], F.get(parts, end - 1)["stop"])).otherwise("inferred")
        optional = (value >= 0) | F.coalesce(F.get(parts, F.col("n") + 1)["plain"] == "?", F.lit(False))
        return rows.select(*KEY, F.col("inside").alias("paren"), "piece", F.when(token["kind"] == "word", token["text"]).alias("name"), token["at"].alias("at"), kind.alias("type"), optional.alias("optional"), F.col("form").startswith("...").alias("rest"))

    # -- imports

    def statements(self) -> DataFrame:
        """start and stop (characters), start_line and end_line and form of each statement."""
        first, last = F.get("parts", F.lit(0)), F.get("parts", F.size("parts") - 1)
        return self.items.where("size(parts) > 0").select(*KEY, "inside", "form", first["start"].alias("start"), last["stop"].alias("stop"), first["line"].alias("start_line"), last["line"].alias("end_line"))

    def imports(self) -> DataFrame:
        """start (of the statement), name, module and imported of all names that imports bind."""
        rows = self.statements().where("form LIKE 'import %'").join(self.files, KEY)
        one = rows.select(F.struct(*KEY, "start").alias("cs_id"), "path", F.substring("content", F.col("start") + 1, F.col("stop") - F.col("start")).alias("content"))
        return facts.bindings(one).select("cs_id.*", F.col("local").alias("name"), "module", "imported")

    def modules(self) -> DataFrame:
        """start and module of each place that imports, re-exports, requires or loads one."""
        text = self.tokens.where("kind = 'string'").select(*KEY, "start", "inside", "prev", "around", F.regexp_replace("text", "^[\"']|[\"']$", "").alias("module"))
        calls = self.tokens.where("opens AND text = '(' AND prev IN ('import', 'require')").select(*KEY, F.col("at").alias("inside"), F.lit(True).alias("loads"))
        return text.join(calls, [*KEY, "inside"], "left").where("prev IN ('from', 'import') OR (loads AND prev IS NULL)").select(*KEY, "start", "module")

    # -- names

    def bindings(self) -> DataFrame:
        """scope, name and what they stand for: key of a declaration, module and imported of an import, neither for parameters and patterns; at of the name (null for imports)."""
        return self.bound

    def _bound(self) -> DataFrame:
        none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
        declared = self.declarations().where("kind NOT IN ('method', 'property', 'enum-member')").select(*KEY, "scope", "name", "at", "key", *none("module", "imported"))
        imports = self.imports().select(*KEY, F.lit(TOP).alias("scope"), "name", F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("key"), "module", "imported")
        # what the round brackets of a function, a catch or a loop bind holds in the body behind them, too
        body = self._follows()
        control = F.col("before").isin(CONTROL)
        parameter = self.parameters().where("name IS NOT NULL").join(body, [*KEY, "paren"]).where(~F.coalesce(control, F.lit(False))).select(*KEY, F.explode(F.array("paren", "body")).alias("scope"), "name", "at", *none("key", "module", "imported"))
        looped = declared.join(body.select(*KEY, F.col("paren").alias("scope"), "body"), [*KEY, "scope"]).select(*KEY, F.col("body").alias("scope"), "name", "at", "key", "module", "imported")
        arrow = self.tokens.where("kind = 'word' AND next = '=>'").select(*KEY, F.col("text").alias("name"), "at", "inside")
        arrows = arrow.join(self._arrows(), [*KEY, "inside"]).where("arrow > at").groupBy(*KEY, "name", "at").agg(F.min_by("body", "arrow").alias("scope")).select(*KEY, "scope", "name", "at", *none("key", "module", "imported"))
        opener = F.get("parts", F.when(F.col("head").rlike(_VARIABLE) & (F.col("piece") == 0), _count(F.regexp_extract("form", f"({_VARIABLE})", 1))).otherwise(0))
        pattern = self.pieces.where(F.col("head").rlike(_VARIABLE) | (F.col("around") == "(")).withColumn("opener", opener).where(F.col("opener.plain").isin("{", "["))
        pattern = pattern.select(*KEY, F.col("opener.at").alias("pattern"), F.col("opener.scope").alias("own"), F.when(~F.col("head").rlike(_VARIABLE), F.col("inside")).alias("paren"))
        pattern = pattern.join(body.where(~F.coalesce(control, F.lit(False))).select(*KEY, "paren", "body"), [*KEY, "paren"], "left").where("paren IS NULL OR body IS NOT NULL")
        inner = self.tokens.where("kind = 'word' AND (next IS NULL OR next IN (',', '=')) AND (prev IS NULL OR prev IN (',', ':', '...'))").select(*KEY, F.col("inside").alias("pattern"), F.col("text").alias("name"), "at")
        patterns = inner.join(pattern, [*KEY, "pattern"]).select(*KEY, F.coalesce("body", "own").alias("scope"), "name", "at", *none("key", "module", "imported"))
        return reduce(DataFrame.unionByName, [declared, imports, parameter, looped, arrows, patterns])

    def _arrows(self) -> DataFrame:
        """(inside, arrow, body): arrow functions and the scope of what follows: the bracket behind, or the arrow itself."""
        by = W.partitionBy(*KEY).orderBy("at")
        rows = self.tokens.withColumn("_next", F.lead("at").over(by)).where("text = '=>' AND kind = 'punct'")
        return rows.select(*KEY, "inside", F.col("at").alias("arrow"), F.when(F.col("next") == "{", F.col("_next")).otherwise(F.col("at")).alias("body"))

    def _follows(self) -> DataFrame:
        """(paren, before, body): round brackets with a body behind them, and the text before them."""
        parts = F.col("parts")
        rows = self.pieces.select(*KEY, "inside", "item", "piece", "parts", F.posexplode("parts").alias("i", "p")).where("p.plain = '(' AND p.kind = 'punct'")
        tail = F.slice(parts, F.col("i") + 3, F.size(parts))  # behind the closing bracket
        first = F.get(tail, F.lit(0))["plain"]
        arrow, brace = _index(tail, "=>"), _index(tail, "{")
        at = lambda i: F.get(tail, i)["at"]
        behind = F.when(F.get(tail, arrow + 1)["plain"] == "{", at(arrow + 1)).otherwise(at(arrow))
        typed = F.when(arrow >= 0, behind).when(F.get(tail, F.size(tail) - 1)["plain"] == "}", at(_last_index(tail, "{")))
        body = F.when(first == "{", at(brace)).when(first == "=>", behind).when(first == ":", typed)
        return rows.select(*KEY, F.col("p.at").alias("paren"), F.get(parts, F.col("i") - 1)["plain"].alias("before"), body.alias("body")).where("body IS NOT NULL")

    def uses(self) -> DataFrame:
        """at, start, line, name, scope and property (the name behind a dot, if any) of each name that is used, not bound."""
        by = W.partitionBy(*KEY).orderBy("at")
        rows = self.tokens.withColumn("property", F.when(F.lead("text").over(by).isin(".", "?."), F.lead("text", 2).over(by)))
        rows = rows.where(F.col("kind") == "word").where(~F.coalesce(F.col("prev").isin(".", "?."), F.lit(False)) & ~F.col("text").isin(KEYWORDS) & ~F.col("text").rlike("^[#@]"))
        rows = rows.join(self.bodies.select(*KEY, F.col("at").alias("inside"), "holds"), [*KEY, "inside"], "left")
        named = (F.coalesce("holds", F.lit("block")) != "block") & F.coalesce(F.col("next").isin(":"), F.lit(False)) & (F.col("prev").isNull() | F.col("prev").isin(",", ";"))
        imported = self.items.where("form LIKE 'import %' AND form NOT LIKE 'import ( )%'").select(*KEY, "inside", "item").withColumn("import", F.lit(True))
        rows = rows.join(imported, [*KEY, "inside", "item"], "left").where("import IS NULL").where(~named)
        for bound in (self.declared, self.bindings().where("at IS NOT NULL")):
            rows = rows.join(bound.select(*KEY, "at"), [*KEY, "at"], "left_anti")
        listed = self.tokens.where("opens AND text = '{'").select(*KEY, F.col("at").alias("inside"), "item", F.col("inside").alias("_inside")).join(imported.select(*KEY, F.col("inside").alias("_inside"), "item"), [*KEY, "_inside", "item"])
        return rows.join(in_place(listed.select(*KEY, "inside")), [*KEY, "inside"], "left_anti").select(*KEY, "at", "start", "line", F.col("text").alias("name"), "scope", "property")

    def references(self) -> DataFrame:
        """at, start, line, name and what the innermost scope that binds the name says: key, or module and imported (of a whole module the property named). Names bound nowhere, and parameters, have no row."""
        chain = self.chains.select(*KEY, "scope", F.posexplode("chain").alias("far", "upper"))
        binds = self.bindings().select(*KEY, F.col("scope").alias("upper"), "name", "key", "module", "imported")
        hits = self.kept(self.uses(), "uses").join(chain, [*KEY, "scope"]).join(binds, [*KEY, "upper", "name"])
        found = hits.withColumn("_nearest", F.min("far").over(W.partitionBy(*KEY, "at"))).where("far = _nearest")
        return found.where("key IS NOT NULL OR module IS NOT NULL").select(*KEY, "at", "start", "line", "name", "key", "module", F.when(F.col("imported") == "*", F.coalesce("property", "imported")).otherwise(F.col("imported")).alias("imported")).distinct()


def _last_before(parts: Column, text: str, end: Column) -> Column:
    places = F.filter(F.transform(parts, lambda p, i: F.when((p["plain"] == text) & ((i < end) | (end < 0)), i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(places, F.size(places) - 1), F.lit(-1))


def _text(content: Column, start: Column, stop: Column) -> Column:
    """The text between two places, its white space single."""
    return F.trim(F.regexp_replace(F.substring(content, start + 1, stop - start), r"\s+", " "))


def compatible_shapes(old: Column, new: Column) -> Column:
    """Whether those who use the old shape can use the new one."""
    functions, objects = ((old["kind"] == k) & (new["kind"] == k) for k in ("function", "object"))
    return F.when(functions, compatible_functions(old, new)).when(objects, compatible_objects(old, new)).otherwise(F.lit(False))
