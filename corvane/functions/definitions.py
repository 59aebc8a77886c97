"""Names that a file defines, by language family, as one Column: rules over lines, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import is_comment, trimmed

MAX_LINES, MAX_LINE, MAX_CHARS, MAX_NAMES = 2000, 1000, 256_000, 128

# Language families, and for each the patterns whose first group is a defined name.
FAMILIES = {"typescript": "script", "tsx": "script", "javascript": "script", "jsx": "script", "python": "python", "go": "go", "rust": "rust", "c": "c", "cpp": "c", "objective-c": "c",
            "java": "java", "csharp": "java", "kotlin": "java", "scala": "java", "cmake": "cmake", "toml": "toml", "markdown": "markdown", "json": "none", "yaml": "none", "xml": "none", "plist": "none"}
_NAME = r"([A-Za-z_$][A-Za-z0-9_$]*)"
RULES = {
    "script": [rf"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:class|interface|function\*?|type|enum|namespace|const|let|var)\s+{_NAME}"],
    "python": [r"^\s*(?:async\s+)?(?:def|class)\s+([A-Za-z_]\w*)"],
    "go": [r"^\s*func\s+(?:\([^)]+\)\s*)?([A-Za-z_]\w*)\s*[\[(]", r"^\s*type\s+([A-Za-z_]\w*)\b"],
    "rust": [r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+([A-Za-z_]\w*)\s*[<(]", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|mod|type)\s+([A-Za-z_]\w*)\b"],
    "c": [r"^\s*#\s*define\s+([A-Za-z_]\w*)", r"^\s*(?:typedef\s+)?(?:struct|class|enum|union|namespace)\s+([A-Za-z_]\w*)\b", r"^(?:[A-Za-z_][\w:<>]*[\s*&]+)+([A-Za-z_]\w*)\s*\([^;]*$"],
    "java": [rf"\b(?:class|interface|enum|record|object|trait)\s+{_NAME}", rf"^\s*(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async|sealed|synchronized|fun|def)\s+)+(?:[\w$<>\[\],.?]+\s+)*{_NAME}\s*\("],
    "cmake": [r"(?i)^\s*(?:function|macro)\s*\(\s*([A-Za-z_]\w*)"],
    "toml": [r"^\s*\[+\s*([A-Za-z0-9_.\"-]+)\s*\]+", r"^\s*\[+\s*(?:[A-Za-z0-9_\"-]+\.)+([A-Za-z0-9_-]+)\s*\]+"],
    "markdown": [r"^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$"],
}


def family(lang: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv]), lang), F.lit("all"))


def definition_identifiers(content: Column, lang: Column) -> Column:
    """Distinct names in order of their lines; at most MAX_NAMES of the first MAX_LINES lines. An unknown language tries every rule.

    In markdown, lines inside fences follow the code rules, all others only the header rule.
    """
    fam = family(lang)
    rows = F.slice(F.split(F.substring(F.coalesce(content, F.lit("")), 1, MAX_CHARS), r"\r?\n"), 1, MAX_LINES)
    fence = F.aggregate(rows, F.struct(F.lit(False).alias("open"), F.array().cast("array<boolean>").alias("seen")), lambda s, x: F.struct(
        (s["open"] != trimmed(x).startswith("```")).alias("open"), F.concat(s["seen"], F.array(s["open"] & ~trimmed(x).startswith("```"))).alias("seen")), lambda s: s["seen"])
    marked = F.when(fam == "markdown", F.zip_with(rows, fence, lambda x, f: F.struct(x.alias("line"), f.alias("code")))).otherwise(F.transform(rows, lambda x: F.struct(x.alias("line"), F.lit(True).alias("code"))))

    def names(row):
        line, found = row["line"], []
        comment = is_comment(trimmed(line)) & ~trimmed(line).rlike(r"^#\s*define\b")
        for f, patterns in RULES.items():
            if f == "markdown":
                applies = ((fam == "markdown") & ~row["code"])
            else:
                applies = ((fam == f) | (fam == "all") | (fam == "markdown")) & row["code"] & ~comment
            for p in patterns:
                found.append(F.when(applies & (F.char_length(line) <= MAX_LINE), F.nullif(F.regexp_extract(line, p, 1), F.lit(""))))
        return F.array_compact(F.array(*found))

    return F.when(fam == "none", F.array().cast("array<string>")).otherwise(F.slice(F.array_distinct(F.flatten(F.transform(marked, names))), 1, MAX_NAMES))
