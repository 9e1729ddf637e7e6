"""The store of a source tree's facts: Parquet by relation and generation, and a manifest that says which of them hold.

A file's facts lie in the generation that extracted it. The manifest is written last and put in place by one rename,
so a reader sees the state before or after, and what a broken run has left is never read."""

from __future__ import annotations

import json
import os
import shutil
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema
from tessera.engine import Engine, Limits
from tessera.errors import QueryError, Status
from tessera.sources.tree import EXTRACTED, LANGUAGES, digest, extract, walk

FOLDER, VERSION = ".tessera", 1
#: Generations after which all facts are written anew.
MOST_GENERATIONS = 16
#: A file changed so shortly before it was read may have changed again with the same time.
RACY_NS = 2_000_000_000


@dataclass
class Entry:
    size: int
    mtime: int
    sha256: str
    gen: int
    read: int


class Store:
    def __init__(self, spark: SparkSession, root: str, at: str | None = None):
        self.spark, self.root = spark, os.path.abspath(root)
        self.at = os.path.abspath(at or os.path.join(self.root, FOLDER))

    # -- manifest and lock

    def manifest(self) -> dict:
        """version, gen, languages, files; a refusal if there is none or it can't be read."""
        path = os.path.join(self.at, "manifest.json")
        if not os.path.isfile(path):
            raise QueryError(Status.NO_INDEX, f"no index at {self.at}; run `index`")
        try:
            with open(path) as f:
                m = json.load(f)
            m["files"] = {k: Entry(**v) for k, v in m["files"].items()}
        except (ValueError, TypeError, KeyError, AttributeError) as e:
            raise QueryError(Status.CORRUPT, f"the manifest can't be read: {e}") from None
        if m.get("version") != VERSION:
            raise QueryError(Status.CORRUPT, f"the index has version {m.get('version')}, this is {VERSION}; run `index --rebuild`")
        return m

    def _commit(self, gen: int, languages: list[str], files: dict[str, Entry]) -> None:
        path = os.path.join(self.at, "manifest.json")
        with open(f"{path}.new", "w") as f:
            json.dump({"version": VERSION, "gen": gen, "languages": languages, "files": {k: asdict(v) for k, v in sorted(files.items())}}, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{path}.new", path)

    def _lock(self) -> int:
        os.makedirs(self.at, exist_ok=True)
        path = os.path.join(self.at, "lock")
        try:
            fd = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            with open(path) as f:
                owner = f.read().strip()
            if owner.isdigit() and os.path.exists(f"/proc/{owner}") or not owner.isdigit():
                raise QueryError(Status.LOCKED, f"another process ({owner}) writes this index") from None
            os.unlink(path)  # of a process that is gone
            return self._lock()
        os.write(fd, str(os.getpid()).encode())
        return fd

    # -- writing

    def changes(self, m: dict | None, languages: set[str] | None = None) -> tuple[dict[str, Entry], list[str], list[str]]:
        """The tree's files, those that are new or changed, and those that are gone. Only files whose size or time differ,
        or were read right after they changed, are hashed."""
        old = m["files"] if m else {}
        now, changed = {}, []
        for path, size, mtime in walk(self.root, languages):
            e = old.get(path)
            if e and (e.size, e.mtime) == (size, mtime) and e.read - e.mtime > RACY_NS:
                now[path] = e
                continue
            sha = digest(self.root, path)
            if e and e.sha256 == sha:
                now[path] = Entry(size, mtime, sha, e.gen, time.time_ns())
            else:
                now[path] = Entry(size, mtime, sha, -1, time.time_ns())
                changed.append(path)
        return now, changed, sorted(set(old) - set(now))

    def index(self, rebuild: bool = False, languages: set[str] | None = None) -> dict:
        """Brings the store up to date; of unchanged files the facts stay."""
        if not os.path.isdir(self.root):
            raise QueryError(Status.NO_INDEX, f"{self.root} is no folder")
        fd = self._lock()
        try:
            try:
                m = None if rebuild else self.manifest()
            except QueryError as e:
                if e.status != Status.NO_INDEX:
                    raise
                m = None
            languages = languages or (set(m["languages"]) if m and m["languages"] else None)
            files, changed, gone = self.changes(m, languages)
            gen = m["gen"] + 1 if m else self._next()
            if changed or gone or m is None:
                live = {e.gen for e in files.values()} - {-1}
                if len(live) >= MOST_GENERATIONS:
                    changed, live = list(files), set()
                if changed:
                    rows = extract(self.spark, self.root, changed, gen)
                    rows.repartition("relation").write.partitionBy("relation").parquet(self._facts(gen))
                    for path in changed:
                        files[path].gen = gen
                    live.add(gen)
                self._commit(gen, sorted(languages or ()), files)
                self._sweep(live)
            elif m["files"] != files:
                self._commit(m["gen"], m["languages"], files)
            return {"files": len(files), "extracted": len(changed), "forgotten": len(gone)}
        finally:
            os.close(fd)
            os.unlink(os.path.join(self.at, "lock"))

    def _facts(self, gen: int) -> str:
        return os.path.join(self.at, "facts", f"gen={gen}")

    def _generations(self) -> list[int]:
        top = os.path.join(self.at, "facts")
        return sorted(int(d[4:]) for d in os.listdir(top) if d.startswith("gen=")) if os.path.isdir(top) else []

    def _next(self) -> int:
        return max(self._generations(), default=-1) + 1

    def _sweep(self, live: set[int]) -> None:
        """Deletes generations of which no file's facts hold any more."""
        for gen in self._generations():
            if gen not in live:
                shutil.rmtree(self._facts(gen), ignore_errors=True)

    # -- reading

    def rows(self, m: dict) -> DataFrame:
        """relation, f, s, n of the facts that hold: those of each file's own generation."""
        live = sorted({e.gen for e in m["files"].values()})
        if not live:
            return self.spark.createDataFrame([], "relation string, f string, gen int, s array<string>, n array<bigint>")
        for gen in live:
            if not os.path.isdir(self._facts(gen)):
                raise QueryError(Status.CORRUPT, f"generation {gen} of the facts is missing; run `index --rebuild`")
        columns = "relation string, f string, gen int, s array<string>, n array<bigint>"
        stored = self.spark.read.schema(columns).option("basePath", os.path.join(self.at, "facts")).parquet(*(self._facts(g) for g in live))
        holds = self.spark.createDataFrame([(p, e.gen) for p, e in m["files"].items()], "f string, gen int")
        return stored.join(holds, ["f", "gen"], "left_semi")

    def load(self, limits: Limits = Limits(), m: dict | None = None) -> Engine:
        """An engine over the facts. What tells relations apart is the folder, so each reads its own files alone."""
        rows = self.rows(m or self.manifest())
        e = Engine(self.spark, limits, code=True)
        for name in schema.RELATIONS:
            e.insert_relation(name, self.relation(rows, name), trusted=True)
        e.scip_ingested, e.root = False, self.root
        return e

    @staticmethod
    def relation(rows: DataFrame, name: str) -> DataFrame:
        s = n = 0
        columns = []
        for c, t in schema.RELATIONS[name]:
            columns.append((F.get("s", F.lit(s)) if t == "str" else F.get("n", F.lit(n))).alias(c))
            s, n = s + (t == "str"), n + (t == "int")
        return rows.where(F.col("relation") == name).select(*columns).distinct()

    def status(self) -> dict:
        """Files by language, what has changed since, files with syntax errors, and whether answers would be fresh."""
        m = self.manifest()
        _, changed, gone = self.changes(m, set(m["languages"]) or None)
        by: dict[str, int] = {}
        for path in m["files"]:
            language = LANGUAGES[os.path.splitext(path)[1]]
            by[language] = by.get(language, 0) + 1
        errors = [{"file": r.f, "line": r.line} for r in self.rows(m).where("relation = 'error'").select("f", F.get("n", F.lit(0)).alias("line")).orderBy("f").limit(20).collect()]
        return {"root": self.root, "generation": m["gen"], "files": by, "extracted": sorted(set(by) & EXTRACTED), "changed": len(changed), "gone": len(gone), "fresh": not changed and not gone, "syntax_errors": errors, "scip": False}


def discover(start: str) -> str:
    """The root of the nearest index: in start or up to 8 folders above it (not past a repository's top), else the only
    one up to 3 folders below."""
    here = os.path.abspath(start)
    for _ in range(9):
        if os.path.isfile(os.path.join(here, FOLDER, "manifest.json")):
            return here
        if os.path.exists(os.path.join(here, ".git")) or os.path.dirname(here) == here:
            break
        here = os.path.dirname(here)
    found, level = [], [os.path.abspath(start)]
    for _ in range(3):
        level = [e.path for d in level for e in sorted(os.scandir(d), key=lambda e: e.name) if e.is_dir(follow_symlinks=False) and not e.name.startswith(".")]
        found += [d for d in level if os.path.isfile(os.path.join(d, FOLDER, "manifest.json"))]
    if len(found) > 1:
        raise QueryError(Status.NO_INDEX, f"several indexes below {start}: {', '.join(found[:5])}")
    if not found:
        raise QueryError(Status.NO_INDEX, f"no index at or around {start}; run `index`")
    return found[0]
