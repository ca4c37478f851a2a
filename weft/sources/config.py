"""Planner settings from a JSON text with comments: strict about names and types, defaults for what is left out."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from weft.operators.planner import Limits

# Default settings.
LIMITS = {"maxGroups": 5, "targetChangedLines": 350, "hardMaxChangedLines": 800, "targetFiles": 12, "hardMaxFiles": 30, "maxAnalysisFiles": 1500, "maxFileBytes": 2097152}
INCLUDE = ["**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx", "**/*.mts", "**/*.cts", "**/*.mjs", "**/*.cjs"]
EXCLUDE = ["**/dist/**", "**/coverage/**", "**/*.min.js"]
TESTS = ["**/*.test.*", "**/*.spec.*", "**/__tests__/**"]
GENERATED = ["**/*.generated.*", "**/generated/**"]
# Greatest allowed value of settings that have one.
GREATEST = {"maxGroups": 20, "maxAnalysisFiles": 20000, "maxFileBytes": 104857600, "timeoutMs": 3600000}


@dataclass(frozen=True)
class Settings:
    base: str = "main"
    head: str = "HEAD"
    limits: dict = field(default_factory=LIMITS.copy)
    include: tuple = tuple(INCLUDE)
    exclude: tuple = tuple(EXCLUDE)
    tests: tuple = tuple(TESTS)
    generated: tuple = tuple(GENERATED)
    generated_from: tuple = ()
    keep_tests: bool = True
    areas: tuple = ()
    checks: tuple = ()
    inherit: bool = False
    allow: tuple = ("CI",)

    def planner(self) -> Limits:
        n = self.limits
        return Limits(n["targetChangedLines"], n["targetFiles"], n["hardMaxChangedLines"], n["hardMaxFiles"], n["maxGroups"], self.keep_tests)


def without_comments(text: str) -> str:
    """JSON text from one with comments and trailing commas; strings stay as they are."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or " ", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare)


def _text(at: str, value) -> str:
    if not isinstance(value, str) or not value or "\0" in value:
        raise ValueError(f"{at}: a text that isn't empty")
    return value


def _flag(at: str, value) -> bool:
    if not isinstance(value, bool):
        raise ValueError(f"{at}: true or false")
    return value


def _number(at: str, value) -> int:
    most = GREATEST.get(at.rsplit(".", 1)[-1], 2**53 - 1)
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= most:
        raise ValueError(f"{at}: a whole number from 1 to {most}")
    return value


def _list(of):
    def read(at: str, value) -> tuple:
        if not isinstance(value, list):
            raise ValueError(f"{at}: a list")
        return tuple(of(f"{at}[{i}]", x) for i, x in enumerate(value))

    return read


def _object(needed: bool = False, **members):
    def read(at: str, value) -> dict:
        if not isinstance(value, dict):
            raise ValueError(f"{at}: an object")
        if strange := sorted(set(value) - set(members)):
            raise ValueError(f"{at}.{strange[0]}: not a known setting")
        if needed and (left_out := sorted(set(members) - set(value))):
            raise ValueError(f"{at}.{left_out[0]}: must be given")
        return {k: members[k](f"{at}.{k}", v) for k, v in value.items()}

    return read


def _const(only):
    def read(at: str, value):
        if value != only or isinstance(value, bool):
            raise ValueError(f"{at}: {only!r}")
        return value

    return read


def _variable(at: str, value) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", _text(at, value)):
        raise ValueError(f"{at}: a variable's name")
    return value


def _argument(at: str, value) -> str:
    return value if value == "" else _text(at, value)


_PATTERNS = _list(_text)
_ROOT = _object(
    **{"$schema": _argument}, schemaVersion=_const(1), base=_text, head=_text, language=_const("typescript"), limits=_object(**dict.fromkeys(LIMITS, _number)),
    paths=_object(include=_PATTERNS, exclude=_PATTERNS),
    relations=_object(keepTestsWithImplementation=_flag, testPatterns=_PATTERNS, generatedPatterns=_PATTERNS, generatedFrom=_list(_object(True, source=_text, generated=_PATTERNS))),
    areas=_list(_object(True, name=_text, patterns=_PATTERNS)),
    checks=_list(_object(True, name=_text, command=_text, args=_list(_argument), timeoutMs=_number)),
    environment=_object(inherit=_flag, allow=_list(_variable)),
)


def settings(text: str = "{}") -> Settings:
    """Settings from JSON text. ValueError names the first member that is unknown, of a wrong type or out of range."""
    given = _ROOT("$", json.loads(without_comments(text)))
    limits = LIMITS | given.get("limits", {})
    for low, high in (("targetChangedLines", "hardMaxChangedLines"), ("targetFiles", "hardMaxFiles")):
        if limits[low] > limits[high]:
            raise ValueError(f"$.limits.{low}: above {high}")
    names = [c["name"] for c in given.get("checks", ())]
    if len(set(names)) < len(names):
        raise ValueError("$.checks: a name twice")
    if any(re.search(r"[\x00-\x1f\x7f-\x9f]", n) for n in names):
        raise ValueError("$.checks: a control character in a name")
    paths, relations, environment = (given.get(k, {}) for k in ("paths", "relations", "environment"))
    found = {
        "base": given.get("base"), "head": given.get("head"), "limits": limits, "include": paths.get("include"), "exclude": paths.get("exclude"),
        "tests": relations.get("testPatterns"), "generated": relations.get("generatedPatterns"), "keep_tests": relations.get("keepTestsWithImplementation"),
        "generated_from": tuple((r["source"], list(r["generated"])) for r in relations["generatedFrom"]) if "generatedFrom" in relations else None,
        "areas": tuple((a["name"], list(a["patterns"])) for a in given["areas"]) if "areas" in given else None,
        "checks": given.get("checks"), "inherit": environment.get("inherit"), "allow": environment.get("allow"),
    }
    return Settings(**{k: v for k, v in found.items() if v is not None})
