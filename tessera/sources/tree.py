"""Source trees: which files there are, and their facts, a task for some files each."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Larger files are generated ones, mostly.
MOST_BYTES = 2 * 1024 * 1024
#: Extension to language. Facts are read from Python; of the other languages the files alone are known.
LANGUAGES = {".py": "python", ".go": "go", ".rs": "rust", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "typescriptreact"}
EXTRACTED = frozenset({"python"})
LONG = "relation string, f string, gen int, s array<string>, n array<bigint>"


def _pattern(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """Of a line of an ignore file: what it matches below its folder, whether it takes back, whether folders only."""
    line = line.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[back:].removeprefix("\\")
    folder = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    out, i = "", 0
    line = line.lstrip("/")
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 2 :]:
            j = line.index("]", i + 2)
            body = line[i + 1 : j].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", j + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    return re.compile(out if anchored else f"(?:.*/)?{out}"), back, folder


def walk(root: str, languages: set[str] | None = None) -> list[tuple[str, int, int]]:
    """Path below root, bytes and modification time (ns) of each source file, sorted: hidden, ignored and very large
    files left out, links not followed."""
    out = []

    def visit(folder: str, rules: list) -> None:
        here = os.path.join(root, folder)
        own = os.path.join(here, ".gitignore")
        if os.path.isfile(own):
            with open(own, encoding="utf-8", errors="replace") as f:
                rules = [*rules, *((folder, p) for p in map(_pattern, f) if p)]
        for e in sorted(os.scandir(here), key=lambda e: e.name):
            path = f"{folder}/{e.name}" if folder else e.name
            directory = e.is_dir(follow_symlinks=False)
            if e.name.startswith(".") or _ignored(path, directory, rules):
                continue
            if directory:
                visit(path, rules)
            elif e.is_file(follow_symlinks=False):
                language = LANGUAGES.get(os.path.splitext(e.name)[1])
                st = e.stat(follow_symlinks=False)
                if language and (not languages or language in languages) and st.st_size <= MOST_BYTES:
                    out.append((path, st.st_size, st.st_mtime_ns))

    visit("", [])
    return sorted(out)


def _ignored(path: str, directory: bool, rules: list) -> bool:
    for base, (pattern, back, folder) in reversed(rules):  # the last one that fits decides
        below = path[len(base) + 1 :] if base else path
        if (directory or not folder) and pattern.fullmatch(below):
            return not back
    return False


def digest(root: str, path: str) -> str:
    with open(os.path.join(root, path), "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def extract(spark: SparkSession, root: str, paths: list[str], gen: int = 0) -> DataFrame:
    """relation, f, gen, s, n: the facts of the files, with `error` (its line) as a relation of its own.

    The files are read where the tasks run, so root has to be a folder that all executors share."""
    from tessera.sources.python_facts import facts

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path in part["path"]:
                language = LANGUAGES[os.path.splitext(path)[1]]
                rows, error = [("file", [path, language], [])], None
                if language in EXTRACTED:
                    with open(os.path.join(root, path), encoding="utf-8", errors="replace", newline="") as f:
                        rows, error = facts(path, f.read())
                if error is not None:
                    rows.append(("error", [path], [error]))
                yield pd.DataFrame({"relation": [r for r, _, _ in rows], "f": path, "gen": gen, "s": [s for _, s, _ in rows], "n": [n for _, _, n in rows]})

    tasks = max(1, min(len(paths) // 16 + 1, 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks).mapInPandas(run, LONG)
