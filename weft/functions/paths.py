"""Path predicates and expansions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """An anchored pattern: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` within one part."""
    out, i = "", 0
    while i < len(glob):
        for mark, pattern in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if glob.startswith(mark, i):
                out += pattern
                i += len(mark)
                break
        else:
            out += re.escape(glob[i])
            i += 1
    return f"^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    found = F.lit(False)
    for g in globs:
        found |= path.rlike(glob_regex(g))
    return found


def first_area(path: Column, areas: list[tuple[str, list[str]]]) -> Column:
    """Name of the first area one of whose patterns matches, else null."""
    return F.coalesce(*[F.when(matches_any(path, globs), F.lit(name)) for name, globs in areas], F.lit(None).cast("string"))


def is_safe(path: Column) -> Column:
    """Relative, without NUL, backslash, drive, or parts that are empty, ``.``, ``..`` or ``.git``."""
    part = F.exists(F.split(path, "/", -1), lambda p: p.isin("", ".", "..") | (F.lower(p) == ".git"))
    return ~(path.isNull() | part | path.contains("\\") | path.contains("\0") | path.rlike("^[A-Za-z]:"))


def ancestors(path: Column) -> Column:
    """All folders above a path, the nearest last; the top is the empty string."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def import_candidates(folder: Column, module: Column, endings: list[str]) -> Column:
    """Files a relative module name may stand for: itself with each ending, and an index file of a folder."""
    base = F.when(folder == "", module).otherwise(F.concat_ws("/", folder, module))
    files = [F.concat(base, F.lit(e)) for e in endings] + [F.concat(base, F.lit(f"/index{e}")) for e in endings]
    return F.array_distinct(F.array(base, *files))


# Endings tried after a module's name, in this order.
ENDINGS = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".d.ts", "/index.ts", "/index.tsx", "/index.js", "/index.d.ts"]


def normalized(path: Column) -> Column:
    """A relative path without empty, ``.`` and inner ``..`` parts; ``..`` stays where it leads out, a last slash stays, nothing gives ``.``."""
    inner = F.filter(F.split(path, "/", -1), lambda p: ~p.isin("", "."))

    def step(kept: Column, part: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        back = (part == "..") & F.coalesce(last != "..", F.lit(False))
        return F.when(back, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(part)))

    joined = F.array_join(F.aggregate(inner, F.array().cast("array<string>"), step), "/")
    return F.concat(F.when(joined == "", F.lit(".")).otherwise(joined), F.when(path.endswith("/"), F.lit("/")).otherwise(F.lit("")))


def import_targets(path: Column, module: Column) -> Column:
    """Paths that a relative module in ``path`` may stand for, those that lead out of the tree or into its own folder left out; none for other modules."""
    folder = F.regexp_replace(path, "(^|/)[^/]*$", "")
    target = normalized(F.when(folder == "", module).otherwise(F.concat(folder, F.lit("/"), module)))
    bare = F.regexp_replace(target, "\\.[cm]?jsx?$", "")
    tries = F.array_distinct(F.array(target, *[F.concat(bare, F.lit(e)) for e in ENDINGS]))
    own = lambda p: F.exists(F.split(p, "/", -1), lambda x: F.lower(x) == ".git")
    inside = F.filter(tries, lambda p: ~(p.isin(".", "..") | p.startswith("../") | p.startswith("/") | p.contains("\\") | p.contains("\0") | own(p)))
    return F.when(module.startswith("."), inside).otherwise(F.array().cast("array<string>"))
