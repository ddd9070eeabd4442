"""URL patterns: globs and regular expressions, as filters and as labels."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(glob: str) -> str:
    """Anchored regular expression for a glob over a whole url: `*` and `**` match any characters, `/` too; `?` one; `[..]` and `{a,b}` as usual."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while glob[i : i + 1] == "*":
                i += 1
            out += ".*"
            continue
        if c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inside = glob[i + 1 : end]
            out += "[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"unclosed brace in glob {glob!r}")
    return f"^{out}$"


@dataclass(frozen=True)
class Pattern:
    """A glob or a regular expression, and what a link that it includes takes from it."""

    text: str
    glob: bool = True
    label: str | None = None
    user_data: dict = field(default_factory=dict)
    method: str | None = None

    def matches(self, url: Column) -> Column:
        return url.rlike(glob_to_regex(self.text) if self.glob else self.text)


def globs(*texts: str, **overrides) -> list[Pattern]:
    return [Pattern(t, True, **overrides) for t in texts]


def regexes(*texts: str, **overrides) -> list[Pattern]:
    return [Pattern(t, False, **overrides) for t in texts]


def included(url: Column, include: list[Pattern]) -> Column:
    """Whether any pattern matches; without patterns, true."""
    out = F.lit(not include)
    for p in include:
        out = out | p.matches(url)
    return out


def include_reason(include: list[Pattern]) -> str:
    return "glob_excluded" if any(p.glob for p in include) else "regex_excluded"


def exclusion(url: Column, exclude: list[Pattern]) -> Column:
    """The reason given by the first pattern that matches; null if none does."""
    out = F.lit(None).cast("string")
    for p in reversed(exclude):
        out = F.when(p.matches(url), "glob_excluded" if p.glob else "regex_excluded").otherwise(out)
    return out


def override(url: Column, include: list[Pattern], name: str, default: Column | None = None) -> Column:
    """Attribute `name` of the first including pattern that matches, else default."""
    first = F.lit(None).cast("string")
    for p in reversed(include):
        first = F.when(p.matches(url), F.lit(getattr(p, name)).cast("string")).otherwise(first)
    return F.coalesce(first, default) if default is not None else first
