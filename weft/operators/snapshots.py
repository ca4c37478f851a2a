"""Which entries of a tree an analysis reads.

tree: cs_id, path, mode, type ('blob' or other), content (null: not text or too large). Content is read only where it is asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.functions.paths import ancestors, import_targets, normalized
from weft.session import materialize

SOURCE = "(?i)\\.[cm]?[jt]sx?$"
CONFIG = "(?i)(^|/)[tj]sconfig(\\.[^/]*)?\\.json$"
_KEY = ["cs_id", "path"]


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def in_folder(folder: Column, name: Column | str) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def _regular(tree: DataFrame) -> DataFrame:
    return tree.where((F.col("type") == "blob") & (F.col("mode") != "120000"))


def ancestor_manifests(paths: DataFrame, name: str = "package.json") -> DataFrame:
    """(cs_id, path): the manifest a folder above each path would have, up to the top."""
    up = F.explode(F.transform(ancestors(F.col("path")), lambda f: in_folder(f, name)))
    return paths.select("cs_id", up.alias("path")).distinct()


def fast_selection(tree: DataFrame, changes: DataFrame, imports: DataFrame) -> DataFrame:
    """Entries (cs_id, path) for a quick look: changed files, manifests above them and what they import directly.

    ``changes`` (cs_id, old_path, new_path), ``imports`` (cs_id, path, module). A path that isn't in the tree selects nothing.
    """
    changed = changes.select("cs_id", F.explode(F.array("old_path", "new_path")).alias("path")).where("path IS NOT NULL").distinct()
    first = tree.join(changed.unionByName(ancestor_manifests(changed)), _KEY, "left_semi")
    source = _regular(first).where(F.col("path").rlike(SOURCE)).select(*_KEY)
    named = imports.join(source, _KEY, "left_semi").select("cs_id", F.explode(import_targets(F.col("path"), F.col("module"))).alias("path"))
    return first.select(*_KEY).unionByName(tree.join(named, _KEY, "left_semi").select(*_KEY)).distinct()


def config_names(configs: DataFrame) -> DataFrame:
    """(cs_id, path, n, place, base): the places where each file named by a configuration (cs_id, path, content) may be, in order."""
    raw = F.from_json("content", "extends string, references array<struct<path:string>>", {"allowComments": "true"})
    c = configs.select("cs_id", "path", raw.alias("c"))
    many = F.when(F.col("c.extends").startswith("["), F.from_json("c.extends", "array<string>")).when(F.col("c.extends").isNotNull(), F.array("c.extends"))
    part = lambda names, local: F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: F.struct(x.alias("name"), F.lit(local).alias("local")))
    named = c.select("cs_id", "path", F.posexplode(F.concat(part(many, False), part(F.col("c.references.path"), True))).alias("n", "x"))
    name = F.translate("x.name", "\\", "/")
    named = named.select("cs_id", "path", "n", name.alias("name"), (F.col("x.local") | name.startswith(".")).alias("local")).where("name IS NOT NULL AND name NOT LIKE '/%'")
    near = F.array(normalized(in_folder(folder_of(F.col("path")), F.col("name"))))
    far = F.transform(F.reverse(ancestors(F.col("path"))), lambda f: normalized(in_folder(f, F.concat(F.lit("node_modules/"), F.col("name")))))
    return named.select("cs_id", "path", "n", F.posexplode(F.when(F.col("local"), near).otherwise(far)).alias("place", "base"))


def config_targets(tree: DataFrame, configs: DataFrame) -> DataFrame:
    """(cs_id, path): for each name in ``configs`` the first file that is there: itself, with an ending, by its package's manifest, or its folder's default."""
    names = config_names(configs)
    manifests = _regular(tree).where(F.regexp_replace("path", "^.*/", "") == "package.json")
    base = F.when(F.col("path").contains("/"), folder_of(F.col("path"))).otherwise(F.lit("."))
    package = manifests.select("cs_id", base.alias("base"), F.get_json_object("content", "$.tsconfig").alias("own")).where("own IS NOT NULL")
    names = names.join(package, ["cs_id", "base"], "left")
    tries = F.array(F.col("base"), F.concat("base", F.lit(".json")), normalized(F.concat("base", F.lit("/"), "own")), normalized(F.concat("base", F.lit("/tsconfig.json"))))
    tries = names.select("cs_id", F.col("path").alias("by"), "n", "place", F.posexplode(tries).alias("turn", "path"))
    there = tries.join(tree.select(*_KEY), _KEY).withColumn("_r", F.row_number().over(W.partitionBy("cs_id", "by", "n").orderBy("place", "turn")))
    return there.where("_r = 1").select(*_KEY).distinct()


def analysis_selection(tree: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Entries (cs_id, path) for a full analysis: sources, JSON files, and all configurations that others extend or refer to.

    One round for each step of the longest chain of configurations, over the new ones only; cycles end since a file is read once. More than
    ``max_rounds`` steps are an error, not a cut.
    """
    selected = tree.where(F.col("path").rlike(SOURCE) | F.lower("path").endswith(".json")).select(*_KEY)
    todo = selected.where(F.col("path").rlike(CONFIG))
    steps = []
    for _ in range(max_rounds):
        content = _regular(tree).join(todo, _KEY, "left_semi")
        done = [todo, *steps]
        found = config_targets(tree, content)
        todo = materialize(found.join(reduce(DataFrame.unionByName, done), _KEY, "left_anti"), "configs")
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, [selected, *steps]).distinct()
        steps.append(todo)
    raise ValueError(f"configurations refer to each other in more than {max_rounds} steps")
