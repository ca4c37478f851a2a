"""Column names that can't clash, and values that are worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns named _in_0, _in_1, ... and those names by the old ones, so that an operator's own columns never meet them."""
    names = [f"_in_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def free_names(own: list[str], taken: list[str]) -> list[str]:
    """The names ``own``, each with as many underscores behind it as keep it apart from those ``taken`` (in any case of letters)."""
    used, out = {t.lower() for t in taken}, []
    for name in own:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with ``value`` worked out once however often ``then`` uses it, inside other lambdas as well."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
