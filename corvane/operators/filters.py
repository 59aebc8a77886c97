"""The filter language of a search: ==, in [...], and, or, parentheses; parsed into a Column."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_LEX = re.compile(r"""\s*(?:(==|[()\[\],])|"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|([A-Za-z_][A-Za-z0-9_]*)|(-?\d+(?:\.\d+)?))""")
_EXTENSION = re.compile(r"^\.[A-Za-z0-9][A-Za-z0-9_+-]*$")


class FilterError(ValueError):
    pass


def _lex(text: str) -> list[tuple[str, object]]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise FilterError(f"unexpected text at {at}: {text[at:at + 20]!r}")
        at = m.end()
        symbol, double, single, name, number = m.groups()
        quoted = double if double is not None else single
        if symbol:
            out.append(("op", symbol))
        elif quoted is not None:
            out.append(("value", re.sub(r"\\(.)", r"\1", quoted)))
        elif number is not None:
            out.append(("value", float(number) if "." in number else int(number)))
        elif name.lower() in ("and", "or", "in"):
            out.append(("op", name.lower()))
        elif name.lower() in ("true", "false"):
            out.append(("value", name.lower() == "true"))
        else:
            out.append(("name", name))
    return out


def parse_filter(text: str, columns: list[str]) -> Column:
    """The Column of a filter expression over these columns; anything else in it is an error."""
    toks, at = _lex(text), 0

    def take(kind, value=None):
        nonlocal at
        if at >= len(toks) or toks[at][0] != kind or (value is not None and toks[at][1] != value):
            raise FilterError(f"expected {value or kind} in {text!r}")
        at += 1
        return toks[at - 1][1]

    def peek(value):
        return at < len(toks) and toks[at] == ("op", value)

    def either():
        parts = [every()]
        while peek("or"):
            take("op", "or")
            parts.append(every())
        return reduce(lambda a, b: a | b, parts)

    def every():
        parts = [one()]
        while peek("and"):
            take("op", "and")
            parts.append(one())
        return reduce(lambda a, b: a & b, parts)

    def one():
        if peek("("):
            take("op", "(")
            inner = either()
            take("op", ")")
            return inner
        name = take("name")
        if name not in columns:
            raise FilterError(f"unknown column {name}")
        if peek("in"):
            take("op", "in")
            take("op", "[")
            values = []
            while not peek("]"):
                values.append(take("value"))
                if not peek("]"):
                    take("op", ",")
            take("op", "]")
            return F.col(name).isin(values)
        take("op", "==")
        return F.col(name) == F.lit(take("value"))

    out = either()
    if at != len(toks):
        raise FilterError(f"text after the end of the filter: {text!r}")
    return out


def extension_filter(extensions: list[str], column: str = "file_extension") -> Column:
    for e in extensions:
        if not _EXTENSION.match(e):
            raise FilterError(f"not a file extension: {e!r}")
    return F.col(column).isin(extensions) if extensions else F.lit(True)


def filename_filter(term: str) -> Column:
    """A path matches relative_path; a bare name matches basename and extension."""
    if "/" in term or "\\" in term:
        return F.col("relative_path") == term.replace("\\", "/")
    base, dot, ext = term.rpartition(".")
    return (F.col("basename") == base) & (F.col("file_extension") == "." + ext) if dot and base else F.col("basename") == term


def anchor_filter(anchors: list[str], cap: int = 12) -> Column:
    """Equality of any of the first `cap` case-insensitively distinct anchors with a structured column; all of it reaches the scan."""
    picked = list({a.lower(): a for a in reversed(anchors)}.values())[::-1][:cap]
    parts = []
    for a in picked:
        base, dot, ext = a.rpartition(".")
        parts += [F.col("primary_symbol") == a, F.col("basename").isin(a, a[:1].lower() + a[1:]), F.col("relative_path") == a]
        parts += [F.col(f"path_segment_{i}") == a for i in range(5)]
        if dot and base and "/" not in a:
            parts.append((F.col("basename") == base) & (F.col("file_extension") == "." + ext))
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)
