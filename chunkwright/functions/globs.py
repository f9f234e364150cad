"""Globs as regular expressions, made when a plan is built."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(glob: str) -> str:
    """``*`` and ``?`` stay within a directory, ``**`` crosses; ``[!x]`` and ``{a,b}`` as usual."""
    out, depth, k = [], 0, 0
    while k < len(glob):
        c = glob[k]
        if c == "*":
            if glob[k : k + 2] == "**":
                out.append(".*")
                k += 1
            else:
                out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in glob[k + 2 :]:
            end = glob.index("]", k + 2)
            body = glob[k + 1 : end]
            body = "^" + body[1:] if body[0] == "!" else ("\\" + body if body[0] == "^" else body)
            out.append("(?!/)[" + body.replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]")
            k = end
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and k + 1 < len(glob):
            k += 1
            out.append(re.escape(glob[k]))
        else:
            out.append(re.escape(c))
        k += 1
    return "^" + "".join(out) + ")" * depth + "$"


def _regex(pattern: str) -> str:
    """Patterns may say ``glob:`` or ``regex:``; a bare one is a glob."""
    kind, _, rest = pattern.partition(":")
    if kind == "regex":
        return f"^(?:{rest})$"
    return glob_to_regex(rest if kind == "glob" else pattern)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def matches(path: Column, pattern: str) -> Column:
    """The path or its file name matches."""
    regex = _regex(pattern)
    return path.rlike(regex) | file_name(path).rlike(regex)


def matches_strictly(path: Column, pattern: str) -> Column:
    """The whole path matches."""
    return path.rlike(_regex(pattern))


def selected(path: Column, include: str | None = None, exclude: str | None = None, *, strict: bool = False) -> Column:
    match = matches_strictly if strict else matches
    keep = match(path, include) if include else F.lit(True)
    return keep & ~match(path, exclude) if exclude else keep
