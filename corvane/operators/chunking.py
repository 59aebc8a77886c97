"""Files to chunks: markdown sections as a window query; code by declaration lines; anything else by size."""

from __future__ import annotations

import ast
import json
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.paths import language

CHUNK_SIZE, OVERLAP = 2500, 300
CHUNK_CAP = 450_000  # chunks of a collection
RANGES, GATHERED = 64, 50_000  # ranges of paths that are counted at a time; paths that may meet in one task
HEADER = r"^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$"


def markdown_sections(files: DataFrame) -> DataFrame:
    """(relative_path, section, start_line, end_line, content, chunk_kind, symbol_name): one row a non-blank section.

    A header line opens a section; what stands before the first is the preamble; a file without headers is one chunk.
    """
    rows = files.select("relative_path", F.posexplode(F.split("content", "\n")).alias("pos", "line")).withColumn("title", F.trim(F.regexp_extract("line", HEADER, 1)))
    w = Window.partitionBy("relative_path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.sum((F.col("title") != "").cast("int")).over(w))
    parts = rows.groupBy("relative_path", "section").agg(
        (F.min("pos") + 1).alias("start_line"), (F.max("pos") + 1).alias("end_line"), F.max_by("title", -F.col("pos")).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n").alias("content"))
    headed = F.max("section").over(Window.partitionBy("relative_path")) > 0
    kind = F.when(F.col("section") > 0, "markdown_section").when(headed, "markdown_preamble").otherwise("markdown")
    return (parts.withColumn("chunk_kind", kind).filter(T.trimmed(F.col("content")) != "")
            .select("relative_path", "section", "start_line", "end_line", "content", "chunk_kind", F.when(F.col("section") > 0, F.col("title")).alias("symbol_name")))


def line_windows(files: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(relative_path, piece, start_line, content): greedy pieces of at most `size` characters on line boundaries,
    each with the tail of the piece before it in front; one array fold a file, no explode before it.
    """
    def add(state, line):
        cur, done, n = state["cur"], state["done"], state["n"]
        joined = F.when(state["empty"], line).otherwise(F.concat(cur, F.lit("\n"), line))
        full = ~state["empty"] & (F.char_length(joined) > size)
        piece = F.struct(cur.alias("content"), state["from"].alias("start_line"))
        return F.struct(F.when(full, line).otherwise(joined).alias("cur"), F.when(full, F.concat(done, F.array(piece))).otherwise(done).alias("done"),
                        (n + 1).alias("n"), F.when(full, n + 1).otherwise(state["from"]).alias("from"), F.lit(False).alias("empty"))

    none = F.array().cast("array<struct<content:string,start_line:int>>")
    start = F.struct(F.lit("").alias("cur"), none.alias("done"), F.lit(0).alias("n"), F.lit(1).alias("from"), F.lit(True).alias("empty"))
    fold = F.aggregate(F.split("content", "\n"), start, add, lambda s: F.concat(s["done"], F.array(F.struct(s["cur"].alias("content"), s["from"].alias("start_line")))))
    rows = files.select("relative_path", F.posexplode(fold).alias("piece", "p")).select("relative_path", "piece", F.col("p.start_line").alias("start_line"), F.col("p.content").alias("own"))
    before = F.lag("own").over(Window.partitionBy("relative_path").orderBy("piece"))
    tail = F.right(before, F.lit(overlap))
    shift = F.size(F.split(tail, "\n"))
    return rows.withColumn("tail", tail).select(
        "relative_path", "piece", F.when(F.col("tail").isNull(), F.col("start_line")).otherwise(F.greatest(F.lit(1), F.col("start_line") - shift)).alias("start_line"),
        F.when(F.col("tail").isNull(), F.col("own")).otherwise(F.concat("tail", F.lit("\n"), "own")).alias("content"))


# Lines that start a declaration, by language family: (node type, pattern). Patterns match the trimmed line, at no indent for scripts.
STARTS = {
    "script": [("export_statement", r"export\s+(?:type\s+)?(?:\*|\{.*\})\s+from\s+['\"][^'\"]+['\"];?$"), ("class_declaration", r"(?:export\s+)?(?:abstract\s+)?class\s+[A-Za-z_$][\w$]*\b"),
               ("function_declaration", r"(?:export\s+)?(?:async\s+)?function\s+[A-Za-z_$][\w$]*\s*\("), ("interface_declaration", r"(?:export\s+)?interface\s+[A-Za-z_$][\w$]*\b"),
               ("type_alias_declaration", r"(?:export\s+)?type\s+[A-Za-z_$][\w$]*\b"), ("lexical_declaration", r"(?:export\s+)?(?:const|let|var)\s+[A-Za-z_$][\w$]*\b")],
    "python": [("class_definition", r"class\s+[A-Za-z_]\w*\b"), ("function_definition", r"(?:async\s+)?def\s+[A-Za-z_]\w*\s*\(")],
    "go": [("package_clause", r"package\s+[A-Za-z_]\w*\s*$"), ("type_declaration", r"type\s+[A-Za-z_]\w*\b"), ("function_declaration", r"func\s+(?:\([^)]+\)\s*)?[A-Za-z_]\w*\s*\("), ("var_declaration", r"(?:var|const)\s+[A-Za-z_]\w*\b")],
    "rust": [("mod_item", r"(?:pub\s+)?mod\s+[A-Za-z_]\w*\s*;?$"), ("use_declaration", r"(?:pub\s+)?use\s+.+;?$"), ("function_item", r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+[A-Za-z_]\w*\s*\("),
             ("struct_item", r"(?:pub(?:\([^)]*\))?\s+)?struct\s+[A-Za-z_]\w*\b"), ("trait_item", r"(?:pub(?:\([^)]*\))?\s+)?(?:enum|trait)\s+[A-Za-z_]\w*\b")],
    "java": [("package_declaration", r"package\s+[A-Za-z0-9_.]+\s*;?$"), ("class_declaration", r"(?:(?:public|private|protected|internal|static|final|abstract|sealed)\s+)*(?:class|interface|struct|enum)\s+[A-Za-z_$][\w$]*\b"),
             ("method_declaration", r"(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async|sealed|synchronized)\s+)*(?:[A-Za-z_$][\w$<>\[\],.?]*\s+)+[A-Za-z_$][\w$]*\s*\(")],
    "c": [("function_definition", r"(?:static\s+)?(?:inline\s+)?[A-Za-z_][\w*\s]+\s+[A-Za-z_]\w*\s*\([^;]*\)\s*\{?")],
}
FAMILY = {"typescript": "script", "tsx": "script", "javascript": "script", "jsx": "script", "python": "python", "go": "go", "rust": "rust", "java": "java", "csharp": "java", "c": "c", "cpp": "c"}
ONE_LINE = {"package_clause", "package_declaration", "export_statement", "use_declaration"}
_COMPILED = {f: [(n, re.compile(p)) for n, p in rules] for f, rules in STARTS.items()}


class Layout:
    """The lines of a file as arrays, from which the extent of every declaration follows without walking them again."""

    def __init__(self, rows: list[str]):
        self.rows = rows
        bare = [r.strip() for r in rows]
        self.blank = np.array([not r for r in bare], bool)
        self.note = np.array([r.startswith(("//", "#", "/*", "*")) or r.endswith("*/") for r in bare], bool)
        self.indent = np.array([sum(4 if c == "\t" else 1 for c in r[: len(r) - len(r.lstrip())]) for r in rows], np.int64)
        self.opens = np.array(["{" in r for r in rows], bool)
        self.depth = np.cumsum([r.count("{") - r.count("}") for r in rows])  # after each line
        place = np.arange(len(rows))
        # the comments above a line begin with the first of them behind the last line of code; a blank line right above cuts them off
        code = np.maximum.accumulate(np.where(self.blank | self.note, -1, place))
        notes = np.flatnonzero(self.note)
        first = notes[np.minimum(np.searchsorted(notes, code, "right"), len(notes) - 1)] if len(notes) else place
        self.lead = place.copy()
        self.lead[1:] = np.where(self.note[:-1], first[:-1], place[1:])

    def first(self, holds: np.ndarray, start: int, missing: int) -> int:
        found = np.flatnonzero(holds[start:])
        return start + int(found[0]) if len(found) else missing

    def end(self, start: int, kind: str, family: str) -> int:
        """Last line of the declaration that starts here: by indentation for Python, else where its braces close again, or before the next text if it opens none."""
        last = len(self.rows)
        if kind in ONE_LINE or (family == "script" and kind == "lexical_declaration" and self.rows[start].rstrip().endswith(";")):
            return start
        if family == "python":
            return self.first(~self.blank & ~self.note & (self.indent <= self.indent[start]), start + 1, last) - 1
        head = start if self.opens[start] else self.first(~self.blank, start + 1, last)
        if head == last:
            return start
        if not self.opens[head]:
            return head - 1
        before = self.depth[start - 1] if start else 0
        return self.first(self.depth <= before, head, start)


def _split_large(text: str, start: int, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """Pieces on line boundaries with the tail of the piece before in front: (start line, end line, text)."""
    pieces, cur, at, held = [], [], start, -1
    for i, line in enumerate(text.split("\n")):
        if cur and held + 1 + len(line) > size:
            pieces.append((at, start + i - 1, "\n".join(cur).strip()))
            cur, at, held = [], start + i, -1
        cur.append(line)
        held += 1 + len(line)
    pieces.append((at, start + text.count("\n"), "\n".join(cur).strip()))
    before = ""
    for a, b, own in pieces:
        tail = before[-overlap:] if overlap and before else ""
        yield (max(1, a - tail.count("\n") - 1) if tail else a), b, f"{tail}\n{own}" if tail else own
        before = own


def declarations(code: str, lang: str) -> list[tuple[str, int, int]]:
    """(node type, first line, last line), 0-based; comments above a declaration belong to it."""
    family, rows = FAMILY.get(lang), code.split("\n")
    if not family:
        return []
    layout, found = Layout(rows), {}
    candidates = np.flatnonzero(~layout.blank & (layout.indent == 0)) if family == "script" else np.flatnonzero(~layout.blank)
    for i in candidates.tolist():
        short = rows[i].strip()
        kind = next((n for n, p in _COMPILED[family] if p.match(short)), None)
        if kind:  # of declarations under one comment the first counts
            found.setdefault(int(layout.lead[i]), (kind, int(layout.lead[i]), layout.end(i, kind, family)))
    return list(found.values())


def python_nodes(code: str) -> list[tuple[str, int, int]] | None:
    """The same from Python's own parser, decorators and comments above included; None if the text does not parse."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return None
    lead, out = Layout(code.split("\n")).lead, []
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            top = min([n.lineno, *(d.lineno for d in n.decorator_list)]) - 1
            out.append(("class_definition" if isinstance(n, ast.ClassDef) else "function_definition", int(lead[top]), n.end_lineno - 1))
    return sorted(out, key=lambda x: (x[1], -x[2]))


SEPARATORS = ["\n\n", "\n", " ", ""]


def split_text(text: str, size: int, overlap: int, separators: list[str] = SEPARATORS) -> list[str]:
    """Recursive character split: at paragraphs, else lines, else words, else characters; pieces are merged up to size."""
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :]
    out: list[str] = []
    cur, held = deque(), 0  # parts of the piece under way, and its length

    for part in text.split(sep) if sep else text:
        if len(part) > size and finer:
            out += [sep.join(cur)] if cur else []
            cur.clear()
            held = 0
            out += split_text(part, size, overlap, finer)
            continue
        grown = lambda: held + len(part) + (len(sep) if cur else 0)
        if cur and grown() > size:
            piece = sep.join(cur)
            out += [piece] if not out or out[-1] != piece else []  # what only stayed as overlap is there already
            while cur and (held > overlap or grown() > size):
                held -= len(cur.popleft()) + (len(sep) if cur else 0)
        held = grown()
        cur.append(part)
    out += [sep.join(cur)] if cur else []
    return [p for p in (x.strip() for x in out) if p]


def notebook_source(raw: str) -> str:
    """Markdown and code cells of a notebook, joined by blank lines. Raises ValueError without a list of cells."""
    cells = json.loads(raw).get("cells")
    if not isinstance(cells, list):
        raise ValueError("a notebook needs a list of cells")
    source = lambda c: "".join(c["source"]) if isinstance(c.get("source"), list) else c.get("source") or ""
    return "\n\n".join(source(c) for c in cells if c.get("cell_type") in ("markdown", "code"))


def chunk_file(path: str, lang: str, content: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start line, end line, content, node type, first piece of its node) of one file, markdown excepted."""
    found = (python_nodes(content) if lang == "python" else None) or declarations(content, lang)
    rows = content.split("\n")
    if found:
        for kind, a, b in found:
            text = "\n".join(rows[a : b + 1])
            if not text.strip():
                continue
            if len(text) <= size:
                yield a + 1, b + 1, text, kind, True
            else:
                for i, (s, e, t) in enumerate(_split_large(text, a + 1, size, overlap)):
                    yield s, e, t, kind if i == 0 else "code", i == 0
        return
    at = 0
    for piece in split_text(content, size, overlap):
        hit = content.find(piece, at)
        hit = max(hit, 0) if hit >= 0 else max(content.find(piece), 0)
        start = content.count("\n", 0, hit) + 1
        yield start, start + piece.count("\n"), piece, "code", True
        at = hit + 1


_CHUNK = pa.schema([("relative_path", pa.string()), ("chunk_index", pa.int32()), ("start_line", pa.int64()), ("end_line", pa.int64()), ("content", pa.string()), ("node_type", pa.string()), ("whole", pa.bool_()), ("error", pa.string())])


def code_chunks(files: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of (relative_path, content) files; a file that cannot be split gives one row with `error`."""
    def run(batches):
        for batch in batches:
            out = {f.name: [] for f in _CHUNK}
            for path, lang, content in zip(*(batch.column(c).to_pylist() for c in ("relative_path", "language", "content")), strict=True):
                try:
                    text = notebook_source(content or "") if lang == "jupyter" else content or ""
                    rows = [(path, i, *c[:4], c[4], None) for i, c in enumerate(chunk_file(path, lang, text, size, overlap))]
                except (ValueError, AttributeError, RecursionError) as e:
                    rows = [(path, 0, 0, 0, None, None, True, f"{type(e).__name__}: {e}")]
                for row in rows:
                    for name, v in zip(out, row, strict=True):
                        out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, _CHUNK)

    rows = files.select("relative_path", language(F.col("relative_path")).alias("language"), "content")
    return rows.mapInArrow(run, "relative_path string, chunk_index int, start_line long, end_line long, content string, node_type string, whole boolean, error string")


def distinct_in_file(chunks: DataFrame, order: Column) -> DataFrame:
    """The first chunk of each normalised content within a file."""
    w = Window.partitionBy("relative_path", "normalized_content_hash").orderBy(order)
    return chunks.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def cut(chunks: DataFrame, cap: int = CHUNK_CAP, gathered: int = GATHERED) -> tuple[str | None, int] | None:
    """Where the first `cap` chunks in path order end: (last path, how many of its chunks); None if there are no more than `cap`.

    Paths are counted in ranges between a few of them, then the range that holds the end is divided in the same
    way, until it has at most `gathered` paths; only these meet in one task.
    """
    path = F.col("relative_path")
    sizes = chunks.groupBy("relative_path").agg(F.count("*").alias("own")).persist()
    try:
        paths, total = sizes.agg(F.count("*"), F.sum("own")).first()
        if (total or 0) <= cap:
            return None
        inside, left = sizes, cap
        while paths > gathered:
            bounds = sorted((r[0] for r in inside.filter(path.isNotNull()).orderBy(F.xxhash64(path), path).limit(RANGES - 1).select(path).collect()), key=str.encode)
            at = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= path))  # a null path comes first
            for i, paths, own in sorted(tuple(r) for r in inside.groupBy(at.alias("at")).agg(F.count("*"), F.sum("own")).collect()):
                if own >= left:
                    break
                left -= own
            inside = inside.filter(at == i)
        upto = F.sum("own").over(Window.orderBy("relative_path").rowsBetween(Window.unboundedPreceding, 0))
        last = inside.withColumn("upto", upto).filter(F.col("upto") >= left).orderBy("upto").first()
        return last.relative_path, left - last.upto + last.own
    finally:
        sizes.unpersist()


def until(chunks: DataFrame, last: str | None, left: int) -> DataFrame:
    """The chunks of all paths before `last`, and its own first `left`."""
    path = F.col("relative_path")
    place = F.row_number().over(Window.partitionBy("relative_path").orderBy("chunk_index"))
    own = chunks.filter(path.eqNullSafe(F.lit(last))).withColumn("place", place).filter(F.col("place") <= left).drop("place")
    return own if last is None else chunks.filter(path.isNull() | (path < last)).unionByName(own)


def capped(chunks: DataFrame, cap: int = CHUNK_CAP) -> DataFrame:
    """The first `cap` chunks in path order, with status limit_reached or completed."""
    end = cut(chunks, cap)
    return (chunks if end is None else until(chunks, *end)).withColumn("status", F.lit("completed" if end is None else "limit_reached"))
