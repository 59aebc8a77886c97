"""Content columns: hashes, line counts, symbols, signatures, line ranges. Every function builds a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"[A-Za-z_$][A-Za-z0-9_$]*"


def lines(content: Column) -> Column:
    return F.split(F.regexp_replace(content, "\r\n", "\n"), "\n")


def squeezed(content: Column) -> Column:
    """All white space runs as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(content, r"(?U)\s+", " "), "^ | $", "")


def content_hash(content: Column) -> Column:
    return F.sha1(content)


def normalised_hash(content: Column) -> Column:
    return F.sha1(squeezed(content))


def chunk_id(path: Column, start: Column, end: Column, content: Column) -> Column:
    return F.concat(F.lit("chunk_"), F.substring(F.sha2(F.concat_ws(":", path, start.cast("string"), end.cast("string"), content), 256), 1, 16))


def trimmed(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def effective_lines(content: Column) -> Column:
    """Lines with code: blank lines, //, # and -- comments, leading HTML comments and block comments do not count.

    Block comments in front of code are cut away first, within and across lines, by one pass over the lines.
    """
    cut_inside = lambda s: F.regexp_replace(s, r"^.*?\*/\s*", "")
    cut_front = lambda s: F.regexp_replace(s, r"^(/\*.*?\*/\s*|<!--.*?-->\s*)+", "")

    def step(state, line):
        rest = trimmed(line)
        stays = state["open"] & (F.instr(rest, "*/") == 0)
        rest = cut_front(F.when(state["open"], cut_inside(rest)).otherwise(rest))
        opens = rest.startswith("/*")
        code = (rest != "") & ~rest.rlike(r"^(//|#|--|/\*|<!--)")
        blank = trimmed(line) == ""
        return F.struct(
            (state["n"] + F.when(~stays & code, 1).otherwise(0)).cast("int").alias("n"),
            F.when(blank, state["open"]).otherwise(stays | opens).alias("open"))

    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("open"))
    return F.aggregate(lines(F.coalesce(content, F.lit(""))), start, step, lambda s: s["n"])


# Declarations in order of precedence, (kind, pattern); the name is the first group.
SYMBOLS = [
    ("class", rf"\bclass\s+({_WORD})\b"), ("interface", rf"\binterface\s+({_WORD})\b"), ("function", rf"\bfunction\s+({_WORD})\b"),
    ("function", r"\b(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("), ("function", r"\bfunc\s+(?:\([^)]+\)\s*)?([A-Za-z_][A-Za-z0-9_]*)\s*\("),
    ("function", r"\b(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("), ("type", rf"\btype\s+({_WORD})\b"), ("enum", rf"\benum\s+({_WORD})\b"),
    ("struct", r"\bstruct\s+([A-Za-z_][A-Za-z0-9_]*)\b"), ("trait", r"\btrait\s+([A-Za-z_][A-Za-z0-9_]*)\b"), ("module", r"\bmod\s+([A-Za-z_][A-Za-z0-9_]*)\b"),
    ("const", rf"\bconst\s+({_WORD})\b"), ("let", rf"\blet\s+({_WORD})\b"), ("var", rf"\bvar\s+({_WORD})\b"),
    ("method", rf"(?m)^\s*(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async|sealed|synchronized)\s+)*(?:[A-Za-z_$][A-Za-z0-9_$<>\[\],.?]*\s+)+({_WORD})\s*\("),
    ("method", rf"(?m)^\s*(?:(?:public|private|protected|static|async|override|readonly)\s+)*({_WORD})\s*\("),
]


def symbol(content: Column) -> Column:
    """struct(kind, name) of the first declaration pattern that matches; null if none does."""
    found = None
    for kind, pattern in SYMBOLS:
        name = F.regexp_extract(content, pattern, 1)
        hit = F.when(name != "", F.struct(F.lit(kind).alias("kind"), name.alias("name")))
        found = hit if found is None else F.coalesce(found, hit)
    return found


def chunk_kind(node_type: Column, symbol_kind: Column) -> Column:
    return (F.when(symbol_kind.isNotNull(), F.concat(symbol_kind, F.lit("_definition"))).when(node_type.contains("export"), "export")
            .when(node_type.contains("declaration") | node_type.contains("definition"), "definition").otherwise("code"))


_RE_EXPORT = {
    "python": r"^(from\s+\.+[A-Za-z0-9_.*]+\s+import\s+.+|__all__\s*=.*)$", "rust": r"^((pub\s+)?mod\s+[A-Za-z_]\w*\s*;?|pub\s+use\s+.+;?)$",
    "": r"""^export\s+(type\s+)?((\*|\{.*\})\s+from\s+['"][^'"]+['"];?|\{.*\};?)$""",
}
_TEST_FILE = r"/(test|tests|__tests__|spec|specs)/|(\.test|\.spec|_test|_spec)\.[a-z0-9]+$|(^|/)test_[^/]+\.py$|(^|/)[^/]+(test\.java|tests\.cs)$"
_ASSERTS = r"\b(assert|expect)\s*\(|\bassert(That|Equals|True|False)\s*\("


def chunk_role(node_type: Column, content: Column, lang: Column, path: Column, sym: Column) -> Column:
    """module_decl > re_export > test_case > assertion > method_body or definition > reference."""
    bare = F.regexp_replace(content, r"(?s)/\*.*?\*/", "")
    bare = F.when(lang == "python", F.regexp_replace(bare, r"(?m)^\s*#.*$", "")).otherwise(F.regexp_replace(bare, r"(?m)^\s*//.*$", ""))
    body = F.filter(F.transform(lines(bare), trimmed), lambda s: s != "")
    every = lambda pattern: (F.size(body) > 0) & F.forall(body, lambda s: s.rlike(pattern))
    exports = F.when(lang == "python", every(_RE_EXPORT["python"])).when(lang == "rust", every(_RE_EXPORT["rust"])).otherwise(every(_RE_EXPORT[""]))
    module = node_type.isin("package_clause", "package_declaration", "mod_item") | (lang.isin("go", "java") & trimmed(content).rlike(r"^package\s+[A-Za-z0-9_.]+\s*;?\s*$"))
    named = F.coalesce(sym["name"].rlike("^(test_|test[A-Z0-9_]|Test[A-Z0-9_])"), F.lit(False))
    test = F.lower(path).rlike(_TEST_FILE) & (named | content.rlike(r"\b(it|test|describe)\s*\(") | content.rlike(_ASSERTS))
    return (F.when(module, "module_decl").when(exports, "re_export").when(test, "test_case").when(sym.isNull() & content.rlike(_ASSERTS), "assertion")
            .when(sym["kind"] == "method", "method_body").when(sym.isNotNull(), "definition").otherwise("reference"))


def is_comment(line: Column) -> Column:
    return line.rlike(r"^(//|#|/\*|\*)|\*/$")


def _first_line(content: Column) -> Column:
    meaningful = F.filter(lines(content), lambda s: (trimmed(s) != "") & ~is_comment(trimmed(s)) & ~trimmed(s).startswith("@"))
    return F.get(meaningful, F.lit(0))


DECLARES = rf"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(class|interface|function|type|enum|const|let|var)\s+({_WORD})\b"
METHOD = rf"^(?:(?:public|private|protected|static|async|override|readonly)\s+)*(?:[A-Za-z_$][A-Za-z0-9_$<>\[\],.?]*\s+)*({_WORD})\s*\([^)]*\)\s*(?:\{{|=>|:)"


def signature(content: Column, wide: bool) -> Column:
    """kind:name of the first meaningful line if it declares something, else null.

    wide: also Python, Go and Rust functions. Near-duplicate tests use the narrow form, evidence the wide one.
    """
    line = _first_line(content)
    short = trimmed(line)
    kind, name = F.regexp_extract(line, DECLARES, 1), F.regexp_extract(line, DECLARES, 2)
    out = F.when(name != "", F.concat_ws(":", kind, name))
    more = [("def", r"^(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\("), ("func", r"^func\s+(?:\([^)]+\)\s*)?([A-Za-z_]\w*)\s*\("),
            ("fn", r"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)\s*\(")] if wide else []
    for label, pattern in [*more, ("method", METHOD)]:
        found = F.regexp_extract(short, pattern, 1)
        out = F.coalesce(out, F.when(found != "", F.concat_ws(":", F.lit(label), found)))
    return out


# How a definition starts in its first line.
OPENINGS = [
    rf"(export\s+)?(default\s+)?(abstract\s+)?(class|interface|function|type|enum|const|let|var)\s+{_WORD}\b", r"(async\s+)?def\s+[A-Za-z_]\w*\s*\(", r"func\s+(\([^)]+\)\s*)?[A-Za-z_]\w*\s*\(",
    r"(pub(\([^)]*\))?\s+)?(async\s+)?fn\s+[A-Za-z_]\w*\s*\(",
    rf"(public|private|protected|internal|static|final|abstract|override|virtual|async|sealed|synchronized|\s)*([A-Za-z_$][A-Za-z0-9_$<>\[\],.?]*\s+)+{_WORD}\s*\(",
]


def opens_definition(content: Column) -> Column:
    """Does the first line that is neither blank nor a // or block comment start a definition?"""
    first = F.get(F.filter(F.transform(lines(content), trimmed), lambda s: (s != "") & ~s.rlike(r"^(//|\*|/\*)")), F.lit(0))
    return F.coalesce(first.rlike("^(" + "|".join(OPENINGS) + ")"), F.lit(False))


def definition_signatures(content: Column) -> Column:
    """Distinct kind:name of all declarations at the start of a line."""
    found = F.transform(lines(content), lambda s: F.when(F.regexp_extract(s, DECLARES, 2) != "", F.concat_ws(":", F.regexp_extract(s, DECLARES, 1), F.regexp_extract(s, DECLARES, 2))))
    return F.array_distinct(F.array_compact(found))


def conflicting(a: Column, b: Column) -> Column:
    """Signature sets of which neither holds the other."""
    return (F.size(F.array_except(a, b)) > 0) & (F.size(F.array_except(b, a)) > 0)


def meaningful_lines(content: Column) -> Column:
    """Distinct squeezed lines of eight characters or more."""
    return F.array_distinct(F.filter(F.transform(lines(content), squeezed), lambda s: F.char_length(s) >= 8))


def line_jaccard(a: Column, b: Column) -> Column:
    """Similarity of two meaningful-line sets; 0 if the smaller has fewer than four."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(F.least(F.size(a), F.size(b)) < 4, F.lit(0.0)).otherwise(both / either)


def balanced_block(content: Column) -> Column:
    """Two lines or more, and as many closing as opening braces, at least one."""
    count = lambda c: F.char_length(content) - F.char_length(F.replace(content, F.lit(c), F.lit("")))
    body = F.size(F.filter(lines(content), lambda s: trimmed(s) != ""))
    return (body >= 2) & (count("{") > 0) & (count("{") == count("}"))


def descriptor_text(col: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(col, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")))


def truncated(col: Column, n: int) -> Column:
    return F.when(F.char_length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col)


def line_range(content: Column, *spellings: tuple[Column, Column]) -> Column:
    """struct(start, end, available): the first spelling with a positive start; a missing or smaller end is inferred from the content."""
    count = F.size(lines(content))
    out = None
    for start, end in spellings:
        s, e = F.try_to_number(start.cast("string"), F.lit("999999999")).cast("long"), F.try_to_number(end.cast("string"), F.lit("999999999")).cast("long")
        hit = F.when(s > 0, F.struct(s.alias("start"), F.when(e >= s, e).otherwise(s + count - 1).alias("end"), F.lit(True).alias("available")))
        out = hit if out is None else F.coalesce(out, hit)
    return F.coalesce(out, F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit(False).alias("available")))


# What introduces a type worth following, and built-in types that are not.
FOLLOWS = [r"@delegate\s+([A-Z][A-Za-z0-9_$]*)\b", r"\b(?:new|extends|implements)\s+([A-Z][A-Za-z0-9_$]*)\b", r":\s*([A-Z][A-Za-z0-9_$]*)\b", r"\bas\s+([A-Z][A-Za-z0-9_$]*)\b", r"\b(?:class|interface|type|enum)\s+([A-Z][A-Za-z0-9_$]*)\b"]
BUILT_IN = "Array Boolean Date Error Map Number Object Promise Record Set String WeakMap WeakSet".split()


def follow_up_symbols(content: Column) -> Column:
    """Distinct capitalised names that a context mentions as types or in import and export lists, built-ins left out."""
    lists = F.flatten(F.transform(F.regexp_extract_all(content, F.lit(r"\b(?:import|export)\s*\{([^}]+)\}"), F.lit(1)), lambda s: F.split(s, ",")))
    listed = F.filter(F.transform(lists, lambda s: F.regexp_extract(s, r"^\s*([^\s]+)", 1)), lambda s: s.rlike("^[A-Z][A-Za-z0-9_$]*$"))
    found = F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in FOLLOWS], listed)
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(x) for x in BUILT_IN]))
