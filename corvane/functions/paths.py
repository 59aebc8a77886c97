"""Path columns: extension, tokens, segments, language, role. Every function builds a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File kinds by extension and by name.
SUPPORTED_EXTENSIONS = """.ts .tsx .js .jsx .py .java .cpp .c .h .hpp .cs .go .rs .php .rb .swift .kt .scala .m .mm .dart .sol
.ex .exs .lua .luau .kts .json .yaml .yml .xml .plist .toml .cmake .gradle .md .markdown .ipynb""".split()
SUPPORTED_NAMES = "cmakelists.txt makefile gnumakefile go.mod go.sum package.json tsconfig.json jsconfig.json pyproject.toml cargo.toml".split()
LANGUAGES = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx", ".py": "python", ".java": "java", ".cpp": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp",
    ".cs": "csharp", ".go": "go", ".rs": "rust", ".php": "php", ".rb": "ruby", ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala",
    ".m": "objective-c", ".mm": "objective-c", ".dart": "dart", ".sol": "solidity", ".ex": "elixir", ".exs": "elixir", ".lua": "lua", ".luau": "luau",
    ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".xml": "xml", ".plist": "plist", ".toml": "toml", ".cmake": "cmake", ".gradle": "gradle",
    ".md": "markdown", ".markdown": "markdown", ".ipynb": "jupyter",
}
NAME_LANGUAGES = {"cmakelists.txt": "cmake", "makefile": "makefile", "gnumakefile": "makefile", "go.mod": "go", "go.sum": "go", "package.json": "json",
                  "tsconfig.json": "json", "jsconfig.json": "json", "pyproject.toml": "toml", "cargo.toml": "toml"}
CODE_EXTENSIONS = ".ts .tsx .js .jsx .mjs .cjs .py .go .rs .java .cs .rb".split()
ENTRY_NAMES = "main app server client bootstrap startup".split()
INDEX_NAMES = "index __init__ mod".split()


def file_name(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -1)


def extension(path: Column) -> Column:
    """'.ext' of the last path part; a leading dot alone starts no extension."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]*$", "$1")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def hidden(path: Column) -> Column:
    """Any path part that starts with a dot."""
    return F.exists(F.split(path, "/"), lambda s: s.startswith("."))


def supported(path: Column, extensions: list[str] = SUPPORTED_EXTENSIONS) -> Column:
    return F.lower(extension(path)).isin([e.lower() for e in extensions]) | F.lower(file_name(path)).isin(SUPPORTED_NAMES)


def language(path: Column) -> Column:
    """By known file name (any case), then by extension (case counts), else text."""
    pick = lambda table, key: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return F.coalesce(pick(NAME_LANGUAGES, F.lower(file_name(path))), pick(LANGUAGES, extension(path)), F.lit("text"))


def normalised(path: Column) -> Column:
    """Forward slashes, none doubled, no leading './'."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", ""), "/+", "/")


def segment(path: Column, i: int) -> Column:
    parts = F.filter(F.transform(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda s: F.trim(s)), lambda s: s != "")
    return F.coalesce(F.get(parts, F.lit(i)), F.lit(""))


def structural_tokens(token: Column) -> Column:
    """Camel-case and punctuation parts; a lone leading capital joins the capitalised part after it."""
    parts = F.filter(F.split(F.regexp_replace(token, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+"), lambda s: s != "")
    glued = F.concat(F.array(F.concat(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))), F.slice(parts, 3, 10_000))
    return F.when(F.get(parts, F.lit(0)).rlike("^[A-Z]$") & F.get(parts, F.lit(1)).rlike("^[A-Z][a-z]"), glued).otherwise(parts)


def path_tokens(path: Column) -> Column:
    """Ordered distinct tokens of two letters or more: raw parts, each followed by its structural parts."""
    raw = F.filter(F.split(path, r"[\\/._-]+"), lambda s: F.char_length(s) >= 2)
    both = F.flatten(F.transform(raw, lambda t: F.concat(F.array(t), F.filter(structural_tokens(t), lambda s: F.char_length(s) >= 2))))
    return F.array_distinct(both)


# What marks a file's role. Path rules need a directory before them ("tests/x.py" at the root is no test).
STYLE_EXTENSIONS = ".css .scss .sass .less .styl .stylus .pcss".split()
DOC_EXTENSIONS = ".md .markdown .mdx .rst .adoc .txt".split()
CONFIG_EXTENSIONS = ".json .jsonc .yaml .yml .xml .plist .toml .ini .conf .env .cmake .gradle".split()
CONFIG_NAMES = """cmakelists.txt makefile gnumakefile package.json pyproject.toml cargo.toml go.mod go.sum tsconfig.json jsconfig.json
pnpm-workspace.yaml androidmanifest.xml info.plist settings.gradle settings.gradle.kts build.gradle build.gradle.kts""".split()
GENERATED = r"/(dist|build|generated|__generated__)/|(\.generated\.|\.gen\.)[^/]*$|(\.d\.ts|\.min\.css|\.bundle\.css)$"
TEST = (r"/(__tests__|test|tests|spec|specs)/|\.(test|spec|e2e)\.[^/]*$|_(test\.go|test\.py|spec\.rb)$|(^|/)test_[^/]*\.py$"
        r"|(^|/)[a-z0-9_-]+(test\.java|tests\.cs)$|_(spec|test)(\.[^./]*)?$")
CONFIG = r"/configs?/|\.config\.[^/]*$|(^|/)\.[^/]*$"
DOCS = r"/docs?/|(^|/)readme\.(md|markdown)$"

_IMPLEMENTS = {
    ".py": r"(?m)^\s*((async\s+)?def\s+[A-Za-z_]\w*\s*\(|class\s+[A-Za-z_]\w*\b)",
    ".go": r"(?m)^\s*(func\s+(\([^)]+\)\s*)?[A-Za-z_]\w*\s*\(|type\s+[A-Za-z_]\w*\s+(struct|interface)\b)",
    ".rs": r"(?m)^\s*(pub(\([^)]*\))?\s+)?((async\s+)?fn\s+[A-Za-z_]\w*\s*\(|(struct|enum|trait|impl)\s+[A-Za-z_]\w*\b)",
}
_IMPLEMENTS_ELSE = r"\b(class|interface|function|enum)\s+[A-Za-z_$][\w$]*\b|\b(const|let|var)\s+[A-Za-z_$][\w$]*\s*=\s*(async\s*)?(\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>"


def without_comments(content: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(content, r"(?s)/\*.*?\*/", ""), r"(?m)^\s*(//|#).*$", "")


def implements(content: Column, ext: Column) -> Column:
    """Does the file define anything itself?"""
    code = without_comments(content)
    found = code.rlike(_IMPLEMENTS_ELSE)
    for e, pattern in _IMPLEMENTS.items():
        found = F.when(ext == e, code.rlike(pattern)).otherwise(found)
    return found


def file_role(path: Column, content: Column | None = None, ext: Column | None = None, anchor_root: bool = False) -> Column:
    """generated > test > config > docs > style > barrel (index files without code of their own) > entrypoint > implementation.

    anchor_root: also apply directory rules to directories at the root.
    """
    low = F.lower(F.regexp_replace(path, r"\\", "/"))
    where = F.concat(F.lit("/"), low) if anchor_root else low
    name, own = file_name(low), F.lower(F.trim(ext)) if ext is not None else None
    own = extension(low) if own is None else F.when(own == "", extension(low)).when(own.startswith("."), own).otherwise(F.concat(F.lit("."), own))
    base = stem(low)
    code = own.isin(CODE_EXTENSIONS)
    role = F.when(where.rlike(GENERATED), "generated").when(where.rlike(TEST), "test")
    role = role.when(where.rlike(CONFIG) | name.isin(CONFIG_NAMES) | own.isin(CONFIG_EXTENSIONS), "config")
    role = role.when(where.rlike(DOCS) | own.isin(DOC_EXTENSIONS), "docs").when(own.isin(STYLE_EXTENSIONS), "style")
    if content is not None:
        indexed = base.isin(INDEX_NAMES) & code & (F.coalesce(content, F.lit("")) != "")
        role = role.when(indexed, F.when(implements(content, own), "implementation").otherwise("barrel"))
    return role.when(base.isin(ENTRY_NAMES) & code, "entrypoint").otherwise("implementation")
