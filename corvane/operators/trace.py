"""Where a symbol is defined, imported, exported and used."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.paths import SUPPORTED_EXTENSIONS, file_role

MODIFIERS = "public|private|protected|static|readonly|async|override|abstract"
SCAN_ROWS = 256  # files whose lines a Python worker holds at a time
MODULE_EXTENSIONS = list(dict.fromkeys([*SUPPORTED_EXTENSIONS, ".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs"]))


# How a symbol is defined.
def definition_pattern(symbol: str) -> str:
    s = re.escape(symbol)
    return "|".join([rf"\b(class|interface|function|type|enum|const|let|var)\s+{s}\b", rf"^\s*(({MODIFIERS})\s+)*{s}\s*\(", rf"\bdef\s+{s}\s*\(",
                     rf"\bfunc\s+(\([^)]+\)\s*)?{s}\s*\(", rf"\bfn\s+{s}\s*\(", rf"\b(struct|enum|trait|mod)\s+{s}\b"])


def symbol_lines(files: DataFrame, symbol: str) -> DataFrame:
    """(relative_path, line, text, flags...) of every line that names the symbol or one of the file's aliases for it.

    Only files that contain the symbol are split into lines. Where files have an array `enclosing` (see
    with_enclosing), lines have its entries as enclosing_symbol.
    """
    if not re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", symbol):
        raise ValueError(f"not an identifier: {symbol!r}")
    s, name = re.escape(symbol), r"([A-Za-z_$][A-Za-z0-9_$]*)"
    holds = files.filter(F.contains("content", F.lit(symbol)))
    aliases = F.array_distinct(F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in (
        rf"\b{name}\s*:\s*{s}\b", rf"\b(?:const|let|var)\s+{name}\s*=\s*new\s+{s}\b", rf"\bthis\.{name}\s*=\s*new\s+{s}\b")]))
    caller = ["enclosing_symbol"] if "enclosing" in files.columns else []
    rows = holds.withColumn("aliases", F.filter(aliases, lambda a: a != symbol)).select(
        "relative_path", "aliases", *(["enclosing"] if caller else []), file_role(F.col("relative_path"), F.col("content")).alias("file_role"), F.posexplode(F.split("content", r"\r?\n")).alias("pos", "text"))
    word = F.col("text").rlike(rf"\b{s}\b")
    alias = F.get(F.filter("aliases", lambda a: F.regexp(F.col("text"), F.concat(F.lit(r"\b"), F.regexp_replace(a, r"\$", r"\\\$"), F.lit(r"\b")))), F.lit(0))
    rows = rows.withColumn("matched", F.when(word, F.lit(symbol)).otherwise(alias)).filter((F.trim("text") != "") & (F.col("matched").isNotNull() | F.col("text").rlike(definition_pattern(symbol))))
    preview = F.trim("text")
    flags = {"is_definition": F.col("text").rlike(definition_pattern(symbol)), "is_import": word & F.col("text").rlike(r"\bimport\b"), "is_export": word & F.col("text").rlike(r"\bexport\b"),
             "is_comment": preview.rlike(r"^(//|/\*|\*|#|<!--)")}
    if caller:
        rows = rows.withColumn("enclosing_symbol", F.get("enclosing", F.col("pos"))).drop("enclosing")
    for n, c in flags.items():
        rows = rows.withColumn(n, c)
    module = F.coalesce(F.nullif(F.regexp_extract("text", r"""\b(?:import|export)\b.*?\bfrom\s*['"]([^'"]+)['"]""", 1), F.lit("")), F.nullif(F.regexp_extract("text", r"""\bimport\s*['"]([^'"]+)['"]""", 1), F.lit("")))
    label = F.regexp_replace(F.col("matched"), r"\$", r"\\\$")
    member = F.regexp_extract_all(F.col("text"), F.concat(F.lit(r"\b"), label, F.lit(r"\b\.([A-Za-z_$][A-Za-z0-9_$]*)\s*\(")), F.lit(1))
    call = F.when(F.size(member) > 0, F.concat(F.lit(symbol + "."), F.get(member, F.lit(0)))).when(F.col("text").rlike(rf"\b{s}\s*\("), F.lit(symbol))
    return rows.select("relative_path", "file_role", (F.col("pos") + 1).alias("line"), preview.alias("preview"), "matched", "is_definition", "is_import", "is_export", "is_comment",
                       F.when(F.col("is_import") | F.col("is_export"), module).alias("module_specifier"), call.alias("call_target"), *caller)


def evidence_rows(lines: DataFrame, max_references: int = 40, start: str | None = None, span: tuple[int, int] | None = None) -> DataFrame:
    """One row a line and kind: definition, import, export, reference, related_test; at most max_references of a kind (200 at most).

    References are ordered by the span of lines in the start path, the start path, call target, caller (where `lines`
    has enclosing_symbol), path and line, all others by the start path, path and line.
    """
    cap = max(1, min(max_references, 200))
    plain = ~F.col("is_definition") & ~F.col("is_import") & ~F.col("is_export") & ~F.col("is_comment") & F.col("matched").isNotNull()
    kinds = F.array_compact(F.array(F.when(F.col("is_definition"), F.lit("definition")), F.when(F.col("is_import"), F.lit("import")), F.when(F.col("is_export"), F.lit("export")),
                                    F.when(plain, F.lit("reference")), F.when((F.col("file_role") == "test") & F.col("matched").isNotNull(), F.lit("related_test"))))
    rows = lines.withColumn("kind", F.explode(kinds))
    here = F.col("relative_path") == F.lit(start or "")
    inside = here & F.col("line").between(*span) if span else F.lit(False)
    of_reference = lambda holds: F.when((F.col("kind") == "reference") & ~holds, 1).otherwise(0)
    caller = ["enclosing_symbol"] if "enclosing_symbol" in lines.columns else []
    w = Window.partitionBy("kind").orderBy(of_reference(inside), F.when(here, 0).otherwise(1), of_reference(F.col("call_target").isNotNull()), *[of_reference(F.col(c).isNotNull()) for c in caller], "relative_path", "line")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap).select("kind", "rank", "relative_path", "line", "preview", "matched", "call_target", "module_specifier", *caller)


def resolve_imports(lines: DataFrame, files: DataFrame, few: bool = False) -> DataFrame:
    """(relative_path, line, module_specifier, resolved_path): the first existing candidate of a relative or rooted specifier. `few` lines, whose number is a parameter, go to where the files are."""
    def join_path(folder, spec):  # '.' and '..' folded away; null outside the tree
        parts = F.filter(F.split(F.when(spec.startswith("/"), spec).otherwise(F.concat_ws("/", folder, spec)), "/"), lambda p: ~p.isin("", "."))
        fold = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.array(F.lit("\0"))))
        return F.when(~F.array_contains(fold, "\0"), F.array_join(fold, "/"))

    folder = F.regexp_extract("relative_path", r"^(.*)/[^/]*$", 1)
    wanted = lines.filter(F.col("module_specifier").rlike(r"^[./]")).withColumn("base", join_path(folder, F.col("module_specifier"))).filter("base is not null")
    bare = F.regexp_extract("base", r"[^/]+(\.[^./]+)$", 1) == ""
    exts = F.array(*[F.lit(e) for e in MODULE_EXTENSIONS])
    options = F.concat(F.array(F.col("base")), F.when(bare, F.transform(exts, lambda e: F.concat("base", e))).otherwise(F.array().cast("array<string>")),
                       F.transform(exts, lambda e: F.concat(F.col("base"), F.lit("/index"), e)))
    cand = wanted.select("relative_path", "line", "module_specifier", F.posexplode(options).alias("priority", "candidate"))
    there = files.select(F.col("relative_path").alias("candidate"))
    found = there.join(F.broadcast(cand), "candidate") if few else cand.join(there.distinct(), "candidate")
    return found.groupBy("relative_path", "line", "module_specifier").agg(F.min_by("candidate", "priority").alias("resolved_path"))


def with_enclosing(files: DataFrame) -> DataFrame:
    """(relative_path, content, enclosing) for braces languages: the symbol around each line, by a scan over the file's lines that keeps the open class and function."""
    skip = {"if", "for", "while", "switch", "catch", "return", "function"}
    cls = re.compile(r"\bclass\s+([A-Za-z_$][\w$]*)")
    fn = re.compile(rf"\bfunction\s+([A-Za-z_$][\w$]*)\s*\(|\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>|\b(?:def|fn|func)\s+([A-Za-z_]\w*)\s*\(|^(?:(?:{MODIFIERS})\s+)*([A-Za-z_$][\w$]*)\s*\([^)]*\)[^;]*\{{")
    quoted = re.compile(r"""(["'`])(?:\\.|(?!\1).)*\1?""")

    def around(text):
        depth, open_class, open_fn, out = 0, None, None, []
        for line in (text or "").split("\n"):
            open_fn = open_fn if open_fn and depth >= open_fn[1] else None
            open_class = open_class if open_class and depth >= open_class[1] else None
            if m := cls.search(line):
                open_class = (m[1], depth + 1)
            if (m := fn.search(line.strip())) and (name := next(g for g in m.groups() if g)) not in skip:
                open_fn = (f"{open_class[0]}.{name}" if open_class else name, depth + 1)
            out.append(open_fn[0] if open_fn else open_class[0] if open_class else None)
            bare = quoted.sub("", line)
            depth = max(0, depth + bare.count("{") - bare.count("}"))
        return out

    def scan(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SCAN_ROWS):
                part = batch.slice(start, SCAN_ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([around(t) for t in part.column(1).to_pylist()], pa.list_(pa.string()))], ["relative_path", "content", "enclosing"])

    return files.select("relative_path", "content").mapInArrow(scan, "relative_path string, content string, enclosing array<string>")


def enclosing_symbols(files: DataFrame) -> DataFrame:
    """(relative_path, line, enclosing_symbol) of every line; see with_enclosing."""
    return with_enclosing(files).select("relative_path", F.posexplode("enclosing").alias("pos", "enclosing_symbol")).select("relative_path", (F.col("pos") + 1).alias("line"), "enclosing_symbol")


def trace_symbol(files: DataFrame, symbol: str, max_references: int = 40, start: str | None = None, span: tuple[int, int] | None = None) -> DataFrame:
    """Evidence rows with enclosing symbol and resolved path."""
    holds = files.filter(F.contains("content", F.lit(symbol)))
    out = evidence_rows(symbol_lines(with_enclosing(holds), symbol), max_references, start, span)
    imports = evidence_rows(symbol_lines(files, symbol), max_references, start, span)  # callers move references only, which import nothing
    return out.join(F.broadcast(resolve_imports(imports, files, few=True)), ["relative_path", "line", "module_specifier"], "left")
