"""Ignore rules: patterns compile once on the driver, rows are judged by a Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and patterns ignored by default.
IGNORE_FILES = [".gitignore", ".cursorignore", ".corvaneignore"]
DEFAULT_PATTERNS = """node_modules/** dist/** build/** out/** target/** coverage/** .nyc_output/** .vscode/** .idea/** *.swp *.swo .git/** .svn/** .hg/**
.cache/** __pycache__/** .pytest_cache/** logs/** tmp/** temp/** *.log .env .env.* *.local *.min.js *.min.css *.min.map *.bundle.js *.bundle.css *.min.json
*.minified.json *.bundle.json *.generated.json *.gen.json generated.json minified.json *.chunk.js *.vendor.js *.polyfills.js *.runtime.js *.map
package-lock.json npm-shrinkwrap.json pnpm-lock.yaml yarn.lock bun.lockb""".split()


def clean_patterns(lines: list[str]) -> list[str]:
    """Patterns without comments and blank lines, each once, in order."""
    return list(dict.fromkeys(x for line in lines if (x := line.rstrip("\r\n").strip()) and not x.startswith("#")))


def scoped(pattern: str, folder: str) -> str:
    """A nested ignore file's pattern, valid below its folder only."""
    negate, body = ("!", pattern[1:]) if pattern.startswith("!") else ("", pattern)
    folder = folder.strip("/")
    if not folder or folder == ".":
        return pattern
    return f"{negate}/{folder}/{body.lstrip('/')}" if "/" in body.rstrip("/") else f"{negate}/{folder}/**/{body}"


def to_regex(pattern: str) -> tuple[bool, str]:
    """(ignores, regex over '/'-joined relative paths) of one gitignore pattern."""
    ignores = not pattern.startswith("!")
    body = pattern if ignores else pattern[1:]
    folder_only, body = body.endswith("/"), body.rstrip("/")
    rooted = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.+", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 1 :]:
            end = body.index("]", i + 1)
            out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ignores, ("^" if rooted else "^(?:.*/)?") + out + ("/.*" if folder_only else "(?:/.*)?") + "$"


def compile_rules(patterns: list[str]) -> list[tuple[bool, str]]:
    return [to_regex(p) for p in clean_patterns(patterns)]


def ignored(path: Column, patterns: list[str]) -> Column:
    """Hidden parts always; otherwise the last pattern that matches decides."""
    verdict = F.lit(False)
    for ignores, rx in compile_rules(patterns):
        verdict = F.when(path.rlike(rx), F.lit(ignores)).otherwise(verdict)
    return F.exists(F.split(path, "/"), lambda s: s.startswith(".")) | verdict


def ignored_path(path: str, rules: list[tuple[bool, str]]) -> bool:
    """The same for one path, used to prune folders while listing."""
    if any(p.startswith(".") for p in path.split("/")):
        return True
    verdict = False
    for ignores, rx in rules:
        if re.match(rx, path):
            verdict = ignores
    return verdict
