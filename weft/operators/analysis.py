"""Units of a change and the source text they touch: hunks to the smallest syntax node around them, nodes to the declarations, references, imports and names in
them, and from those the edges between units.

hunks: cs_id, unit_id, side ('old' or 'new'), path, hunk_id, first, last (lines from 1). A hunk without lines on a side touches nothing there. All joins of
places and ranges go by power-of-two bins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.paths import import_targets
from weft.operators import edgerules, hunks as hunk_rules, intervals
from weft.operators.source import KEY, Source, compatible_shapes, in_place
from weft.session import materialize


def syntax_nodes(source: Source) -> DataFrame:
    """start_line, end_line, start and stop of what a hunk can belong to: declarations, statements at the top, imports, exports and calls anywhere, and the whole file."""
    lines = ["start_line", "end_line", "start", "stop"]
    declared = source.declarations().select(*KEY, *lines, F.lit(2).alias("depth"))
    stated = source.statements().where("inside = -1 OR form RLIKE '^(import|export) ' OR form RLIKE '^[^ ]+( [.] [^ ]+)* [(] [)]( ;)?$'").select(*KEY, *lines, F.lit(1).alias("depth"))
    n = F.length("content")
    whole = source.files.where("content IS NOT NULL").select(*KEY, F.lit(0).alias("start_line"), F.lit(1 << 30).alias("end_line"), F.lit(0).alias("start"), n.alias("stop"), F.lit(0).alias("depth"))
    return declared.unionByName(stated).unionByName(whole)


def hunk_nodes(hunks: DataFrame, source: Source) -> DataFrame:
    """unit_id, hunk_id and the node (start, stop, node_start and node_end in lines) of each hunk: the smallest by characters around its lines."""
    rows = hunks.where("first <= last").select(*KEY, "unit_id", "hunk_id", "first", "last")
    found = intervals.stabbed(rows, in_place(syntax_nodes(source)), KEY, "first", "start_line", "end_line").where("end_line >= last")
    best = F.min_by(F.struct("start", "stop", "start_line", "end_line"), F.struct(F.col("stop") - F.col("start"), -F.col("depth"), "start"))
    out = found.groupBy(*KEY, "unit_id", "hunk_id").agg(best.alias("n"))
    return out.select(*KEY, "unit_id", "hunk_id", F.col("n.start").alias("start"), F.col("n.stop").alias("stop"), F.col("n.start_line").alias("node_start"), F.col("n.end_line").alias("node_end"))


def merged_units(hunks: DataFrame, source: Source) -> DataFrame:
    """(hunk_id, unit): hunks whose nodes are the same or nested on either side are one unit; the least hunk names it."""
    nodes = hunk_nodes(hunks, source).select("cs_id", F.col("path").alias("file"), "side", "hunk_id", F.col("start"), (F.col("stop") - 1).alias("end"))
    return hunk_rules.merged_hunks(nodes)


class UnitFacts:
    """What the units declare, refer to, import and name, on each side."""

    def __init__(self, hunks: DataFrame, source: Source) -> None:
        self.source = source
        nodes = hunk_nodes(hunks, source).select(*KEY, "unit_id", F.col("start").alias("node"), (F.col("stop") - 1).alias("node_end")).distinct()
        self.nodes = source.kept(nodes, "unit_nodes")
        self.tree = source.files.select("cs_id", "side", "path").distinct()

    def _inside(self, places: DataFrame) -> DataFrame:
        return intervals.stabbed(places, self.nodes, KEY, "start", "node", "node_end").drop("node", "node_end")

    def declared(self) -> DataFrame:
        """cs_id, unit_id, symbol, side, signature, shape: declarations within a unit's nodes or around them, on either side; those of one key are one."""
        d = self.source.declarations().select(*KEY, "key", "start", (F.col("stop") - 1).alias("stop"))
        touched = intervals.nested_either_way(self.nodes, d, KEY, ("node", "node_end"), ("start", "stop")).select("cs_id", "path", "unit_id", "key").distinct()
        rows = touched.join(self.source.shapes(), ["cs_id", "path", "key"])  # what is touched on one side counts on both
        every = F.array_sort(F.collect_list(F.struct("at", "signature", "shape")), lambda a, b: a["at"] - b["at"])
        one = rows.groupBy("cs_id", "path", "unit_id", F.col("key").alias("symbol"), "side").agg(every.alias("_s"))
        single = F.size("_s") == 1
        return one.select("cs_id", "unit_id", "symbol", "side", F.array_join(F.transform("_s", lambda s: s["signature"]), "\n").alias("signature"), F.when(single, F.get("_s", F.lit(0))["shape"]).alias("shape"))

    def _resolved(self, rows: DataFrame) -> DataFrame:
        """``rows`` with target: the file of their side that their module stands for, null where there is none."""
        tried = rows.select("cs_id", "side", "path", "module").distinct().withColumn("candidates", import_targets(F.col("path"), F.col("module")))
        ask = tried.select("cs_id", F.struct("path", "module").alias("unit_id"), "side", "candidates")
        tree = self.tree.select(F.struct("cs_id", "side").alias("cs_id"), "path")
        hit = edgerules.resolved_modules(ask.withColumn("cs_id", F.struct("cs_id", "side")), tree).select(F.col("cs_id.cs_id").alias("cs_id"), "side", F.col("unit_id.path").alias("path"), F.col("unit_id.module").alias("module"), F.col("path").alias("target"))
        return rows.join(hit, ["cs_id", "side", "path", "module"], "left")

    def referenced(self) -> DataFrame:
        """cs_id, unit_id, symbol, side: keys that names in a unit's nodes mean, in its own file or through an import; import statements refer to what they name."""
        found = self._inside(self.source.references().select(*KEY, "start", "key", "module", "imported"))
        stated = self._inside(self.source.imports().select(*KEY, "start", F.lit(None).cast("string").alias("key"), "module", "imported")).where("imported <> '*'")
        rows = self._resolved(found.unionByName(stated))
        symbol = F.coalesce("key", F.when(F.col("imported") != "*", F.concat("target", F.lit("#"), "imported")))
        return rows.select("cs_id", "unit_id", symbol.alias("symbol"), "side").where("symbol IS NOT NULL").distinct()

    def modules(self) -> DataFrame:
        """cs_id, unit_id, path (imported), side."""
        used = self._inside(self.source.references().where("module IS NOT NULL").select(*KEY, "start", "module"))
        rows = self._resolved(self._inside(self.source.modules()).unionByName(used))
        return rows.where("target IS NOT NULL").select("cs_id", "unit_id", F.col("target").alias("path"), "side").distinct()

    def imports(self) -> DataFrame:
        """cs_id, unit_id, path, module, side: modules as they are written."""
        return self._inside(self.source.modules()).select("cs_id", "unit_id", "path", "module", "side").distinct()

    def bindings(self) -> DataFrame:
        """cs_id, unit_id, path, local, imported, module, side of the import statements in a unit's nodes."""
        return self._inside(self.source.imports()).select("cs_id", "unit_id", "path", F.col("name").alias("local"), "imported", "module", "side").distinct()

    def names(self) -> DataFrame:
        """cs_id, unit_id, path, name, side: all names that stand in a unit's nodes, bound or used."""
        words = self.source.tokens.where("kind = 'word'").select(*KEY, "start", F.col("text").alias("name"))
        return self._inside(words).select("cs_id", "unit_id", "path", "name", "side").distinct()


def source_edges(units: DataFrame, hunks: DataFrame, source: Source) -> DataFrame:
    """(cs_id, src, dst, kind, weight, evidence) of the rules on symbols, files, tests and bindings, from source text.

    units: cs_id, unit_id, old_path, new_path, change_kind, is_test.
    """
    facts = UnitFacts(hunks, source)
    declared, referenced, modules = (materialize(x, "unit-facts") for x in (facts.declared(), facts.referenced(), facts.modules()))
    pairs = edgerules.reference_pairs(units, referenced, modules)
    found = [
        edgerules.symbol_rules(declared, referenced, compatible_shapes),
        edgerules.file_rules(units, referenced, modules),
        edgerules.test_rules(units, declared, referenced, pairs),
        edgerules.binding_rules(facts.bindings(), facts.names()),
    ]
    return reduce(DataFrame.unionByName, found).distinct()
