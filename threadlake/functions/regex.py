r"""Python regular expressions as predicates of the JVM.

Patterns are checked with Python's re, so errors are the same, then written for Java: (?P<n>...) and (?P=n), \Z, [ and &&
inside classes, and flags for Unicode classes, Unicode case and line feeds as the only line ends. A pattern that cannot be
written so (conditional groups, and names that Java forbids) runs in Arrow batches in Python instead.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def to_java(pattern: str) -> str | None:
    """The pattern for Java without flags, or None."""
    with warnings.catch_warnings():  # a bracket inside a set is what it says
        warnings.simplefilter("ignore", FutureWarning)
        re.compile(pattern)
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        two = pattern[i : i + 2]
        if c == "\\":
            if two == "\\Z":
                out.append("\\z")
            elif two in ("\\N", "\\z"):
                return None
            else:
                out.append(two)
            i += 2
            continue
        if in_class:
            if c == "]" and i > first:
                in_class = False
                out.append(c)
            elif c == "[":
                out.append("\\[")
            elif c == "]":
                out.append("\\]")
            elif two == "&&":
                out.append("\\&\\&")
                i += 1
            else:
                out.append(c)
            i += 1
            continue
        if c == "[":
            in_class = True
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            first = i + 1
            i += 1
            continue
        if pattern.startswith("(?P<", i):
            name = pattern[i + 4 : pattern.index(">", i)]
            if not re.fullmatch("[a-zA-Z][a-zA-Z0-9]*", name):
                return None
            out.append("(?<")
            i += 4
            continue
        if pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            out.append(f"\\k<{pattern[i + 4 : end]}>")
            i = end + 1
            continue
        if pattern.startswith("(?(", i) or re.match(r"\(\?[aLux]", pattern[i:]):
            return None
        out.append(c)
        i += 1
    return "".join(out)


def matches(text: Column, pattern: str, case_sensitive: bool = False) -> Column:
    """Whether the pattern is found anywhere in the text."""
    java = to_java(pattern)
    if java is not None:
        return text.rlike(("(?Ud)" if case_sensitive else "(?iuUd)") + java)
    compiled = re.compile(pattern, 0 if case_sensitive else re.I)

    @F.pandas_udf("boolean")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: None if t is None else compiled.search(t) is not None)

    return found(text)


def any_of(text: Column, patterns: list[str], case_sensitive: bool = False) -> Column:
    """Whether any pattern is found; each its own predicate, so flags stay local."""
    out = F.lit(False)
    for p in patterns:
        out = out | matches(text, p, case_sensitive)
    return out
