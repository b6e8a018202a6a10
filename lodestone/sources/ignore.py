"""Ignore patterns compiled to regular expressions, so that path filters and scans stay in the plan.

A path is judged from its topmost folder down: below an ignored folder nothing can be taken back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_regex(pattern: str) -> tuple[str, bool] | None:
    """(regular expression for one relative path, folders ending with a slash, whether it takes back); None for blanks and comments."""
    text = pattern.rstrip()
    if not text or text.startswith("#"):
        return None
    keep = text.startswith("!")
    text = text[1:] if keep else text.removeprefix("\\")
    only_dir, text = text.endswith("/"), text.rstrip("/")
    anchored, text = "/" in text, text.lstrip("/")
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if text.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif text.startswith("**", i):
            out, i = out + ".+", i + 2
        elif c == "[" and "]" in text[i + 2 :]:
            end = text.index("]", i + 2)
            body = text[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
            i += 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/$" if only_dir else "/?$"), keep


@dataclass(frozen=True)
class Scope:
    """The patterns of one ignore file; ``folder`` is its place, "" the root."""

    folder: str
    patterns: tuple[str, ...]


def _own(path: Column, patterns: tuple[str, ...] | list[str]) -> Column:
    """What the patterns say of a path itself: 1 ignored, -1 taken back, 0 nothing. The last that matches counts."""
    out = F.lit(0)
    for pattern in patterns:
        got = to_regex(pattern)
        if got:
            out = F.when(path.rlike(got[0]), F.lit(-1 if got[1] else 1)).otherwise(out)
    return out


def _above(path: Column) -> Column:
    """The folders around a path, topmost first, each with a slash at its end."""
    parts = F.split(F.rtrim(path, F.lit("/")), "/")
    return F.transform(
        F.slice(F.sequence(F.lit(0), F.size(parts) - 1), F.lit(2), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))
    )


def judged(path: Column, patterns: tuple[str, ...] | list[str]) -> Column:
    """1 if the path or a folder around it is ignored, -1 if the path is taken back, else 0."""
    under = F.exists(_above(path), lambda d: _own(d, patterns) == 1)
    return F.when(under, 1).otherwise(_own(path, patterns))


def ignored(path: Column, patterns: list[str]) -> Column:
    return judged(path, patterns) == 1 if patterns else F.lit(False)


def scoped(path: Column, scopes: list[Scope]) -> Column:
    """Whether the path itself is ignored by the scopes around it; a later (deeper) one may take back what an earlier one ignores."""
    out = F.lit(False)
    for s in scopes:
        inside = path if not s.folder else F.substring(path, F.lit(len(s.folder) + 2), F.length(path))
        says = judged(inside, s.patterns)
        told = F.when(says == 1, True).when(says == -1, False).otherwise(out)
        out = told if not s.folder else F.when(F.startswith(path, F.lit(s.folder + "/")) & (path != s.folder + "/"), told).otherwise(out)
    return out


def excluded(path: Column, scopes: list[Scope]) -> Column:
    """Whether a walk that doesn't enter ignored folders leaves the path out."""
    return F.exists(_above(path), lambda d: scoped(d, scopes)) | scoped(path, scopes)


def path_filter(path: Column, ignore: list[str] | None = None, only: list[str] | None = None) -> Column:
    keep = ~ignored(path, ignore or [])
    return keep & ignored(path, only) if only else keep
