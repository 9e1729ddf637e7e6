"""The engine: relations, rules and queries, and the answers to them."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from importlib import resources

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera import schema
from tessera.errors import QueryError, Status, invalid
from tessera.plans.check import check, reachable, stratify
from tessera.plans.compile import name_of
from tessera.plans.evaluate import Evaluation
from tessera.plans.syntax import MOST_INT, Const, Rule, atoms, goal_columns, parse


@dataclass(frozen=True)
class Limits:
    """Of an answer's rows and bytes; of rows derived: those of written predicates, of each round and of the goal's body
    before duplicates go, refused once they are counted; of time, at which running jobs are cancelled. None: no limit."""

    rows: int | None = 1000
    bytes: int | None = 262_144
    derived: int | None = 10_000_000
    milliseconds: int | None = 60_000


@dataclass
class Answer:
    status: Status
    columns: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    truncated: bool = False
    cap: str | None = None
    hint: str = ""
    root: str = ""
    stats: dict = field(default_factory=dict)

    def to_dict(self) -> dict:
        return {"status": self.status.value, "columns": self.columns, "rows": [list(r) for r in self.rows], "truncated": self.truncated, "cap": self.cap, "hint": self.hint, "root": self.root, "stats": self.stats}

    def to_text(self) -> str:
        """A line for each row, columns between tabs, control characters escaped; `true` for a ground goal that holds."""
        if not self.columns:
            return "true\n" * bool(self.rows)
        return "".join("\t".join(escape(str(v)) for v in r) + "\n" for r in self.rows)

    def exit_code(self, expect_empty: bool = False) -> int:
        """0, or 1 for an error; with expect_empty 1 if there are rows and 2 if the query hasn't run."""
        if expect_empty:
            return 2 if not self.status.answered else int(bool(self.rows))
        return int(not self.status.answered)


class Timed:
    """Cancels the Spark jobs started within it after so many milliseconds; over tells whether it has."""

    def __init__(self, spark: SparkSession, milliseconds: int | None):
        self.sc, self.tag, self.over = spark.sparkContext, f"tessera-{uuid.uuid4().hex}", False
        self.timer = None if milliseconds is None else threading.Timer(milliseconds / 1000, self.stop)
        if milliseconds == 0:
            raise QueryError(Status.TIMEOUT, "the time is over")

    def stop(self) -> None:
        self.over = True
        self.sc.cancelJobsWithTag(self.tag)

    def __enter__(self) -> Timed:
        self.sc.addJobTag(self.tag)
        if self.timer:
            self.timer.start()
        return self

    def __exit__(self, *_) -> None:
        if self.timer:
            self.timer.cancel()
        self.sc.removeJobTag(self.tag)
        if self.over and _[0] is None:
            raise QueryError(Status.TIMEOUT, "the time is over")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")


def stdlib() -> str:
    return resources.files("tessera.rules").joinpath("stdlib.dl").read_text()


class Engine:
    def __init__(self, spark: SparkSession, limits: Limits = Limits(), code: bool = False):
        """code: with the relations that describe source code, empty at first, and the rules over them."""
        self.spark, self.limits = spark, limits
        self.base: dict[str, tuple[DataFrame, list[str]]] = {}
        self.rules: list[Rule] = []
        self.heads: list[set[str]] = []  # of each load
        self.docs: dict[str, tuple[str, str]] = {}  # signature and meaning of rules that say so
        self.warm: dict = {}  # predicates that are finished, while relations and rules stay
        self.scip_ingested, self.stale, self.root = True, False, ""
        self.make: Callable[[set[str]], dict[str, DataFrame]] | None = None
        self.waiting: set[str] = set()  # base relations that make() gives once something reads them
        if code:
            for name in schema.RELATIONS:
                self.insert_relation(name, spark.createDataFrame([], schema.ddl(name)), trusted=True)
            self.load_rules(stdlib())

    # -- what queries read

    def insert_relation(self, name: str, df: DataFrame, distinct: bool = False, trusted: bool = False) -> None:
        """Installs or replaces a base relation: strings and integers only. distinct: drop duplicate rows now.

        Nulls and integers outside the range are refused, for which the rows are read once; trusted: known to have none."""
        types, columns = [], []
        for i, f in enumerate(df.schema.fields):
            kind = f.dataType.simpleString()
            if kind not in ("string", "bigint", "int", "smallint", "tinyint"):
                raise invalid(f"column `{f.name}` of `{name}` is {kind}; relations hold strings and integers")
            types.append("str" if kind == "string" else "int")
            columns.append(F.col(f"`{f.name}`").cast("string" if kind == "string" else "bigint").alias(f"c{i}"))
        out = df.select(*columns)
        if not trusted and columns:
            bad = [F.count_if(F.col(c).isNull() | (~F.col(c).between(0, MOST_INT) if t == "int" else F.lit(False))).alias(c) for c, t in zip(out.columns, types)]
            for f, n in zip(df.schema.fields, out.agg(*bad).first()):
                if n:
                    raise invalid(f"column `{f.name}` of `{name}` has {n} values that are null or outside 0..{MOST_INT}")
        self.warm = {}
        self.base[name] = (out.distinct() if distinct else out), types
        self.waiting.discard(name)

    def provide(self, names, make: Callable[[set[str]], dict[str, DataFrame]]) -> None:
        """Base relations, of the types that they have here, which make() gives when the first query that needs them runs."""
        self.warm, self.make, self.waiting = {}, make, set(names)

    def fill(self, names=None) -> None:
        """Makes what is still waiting of these relations; of all, if none are named."""
        need = self.waiting if names is None else self.waiting & set(names)
        if need:
            warm = self.warm  # nothing finished has read them
            for name, df in self.make(set(need)).items():
                self.insert_relation(name, df, trusted=True)
            self.warm = warm

    def load_rules(self, text: str) -> list[str]:
        """Adds clauses; all or none. Returns the heads that clauses before had as well."""
        program = parse(text)
        if program.query is not None:
            raise invalid("a rule file holds no query")
        check(program, self.arities(), tuple(self.rules))
        stratify([*self.rules, *program.rules])
        self.warm = {}
        heads = {r.head.name for r in program.rules}
        widened = sorted(heads & set().union(*self.heads))
        self.rules += program.rules
        self.heads.append(heads)
        for line in text.splitlines():  # %% signature  what it means
            if line.startswith("%% "):
                signature, _, words = line[3:].partition(")")
                self.docs[signature.partition("(")[0]] = (f"{signature})", words.strip())
        return widened

    def load_facts(self, text: str) -> int:
        """Installs relations from ground facts; returns how many there are."""
        from tessera.sources.facts import read_facts

        facts = read_facts(text)
        for name, rows in facts.items():
            self.insert_relation(name, frame(self.spark, rows, schema.types_of(name) if name in schema.RELATIONS else None))
        return sum(map(len, facts.values()))

    def arities(self) -> dict[str, int]:
        return {k: len(v[1]) for k, v in self.base.items()}

    # -- queries

    def plan(self, text: str):
        """Rules the goal can reach, the goal, its columns, and the loaded heads that the program shadows."""
        program = parse(text)
        if program.query is None:
            raise invalid("a query program has a goal, `?- ... .`")
        own = {r.head.name for r in program.rules}
        shadowed = sorted(own & {r.head.name for r in self.rules})
        loaded = tuple(r for r in self.rules if r.head.name not in own)
        rules, goal = check(program, self.arities(), loaded)
        needed = reachable({a.name for a, _ in atoms(goal)}, rules)
        rules = [r for r in rules if r.head.name in needed]
        stratify(rules)
        return rules, goal, goal_columns(goal), shadowed

    def evaluate(self, text: str, seeds: bool = True, watch: bool = False) -> tuple[DataFrame, list[str], Evaluation, dict]:
        rules, goal, columns, shadowed = self.plan(text)
        deadline = None if self.limits.milliseconds is None else time.monotonic() + self.limits.milliseconds / 1000
        depends = sorted(reachable({a.name for a, _ in atoms(goal)}, rules) & set(self.base))
        self.fill(depends)
        ev = Evaluation(self.spark, rules, self.base, self.limits.derived, deadline, seeds, None if parse(text).rules else self.warm)
        env = ev.goal(goal)
        if watch:
            ev.answer = Observation()
            env.df = env.df.observe(ev.answer, F.count(F.lit(1)).alias("n"))
        if columns:
            df = env.df.select(*(F.col(name_of(c)).alias(c) for c in columns))
            df = df if env.unique else df.distinct()
        else:
            df = env.df.limit(1).select(F.lit(True).alias("holds"))
        mixed = [c for c in columns if env.types[c] == "mix"]
        return df, columns, ev, {"depends": depends, "shadowed": shadowed, "mixed": mixed}

    def dataframe(self, text: str, seeds: bool = True) -> DataFrame:
        """The whole answer, lazily where nothing recurs; a ground goal has the column holds."""
        return self.evaluate(text, seeds)[0]

    def query(self, text: str, limit: int | None = None, raw: bool = True) -> Answer:
        """The answer in the order of its rendered rows, cut at the limits."""
        try:
            with Timed(self.spark, self.limits.milliseconds) as clock:
                return self.answer(text, limit, raw)
        except QueryError as e:
            return Answer(e.status, hint=str(e), root=self.root)
        except Exception as e:
            if clock.over:
                return Answer(Status.TIMEOUT, hint=f"no answer in {self.limits.milliseconds} ms", root=self.root)
            if "invalid-query:" not in str(e):
                raise
            return Answer(Status.INVALID_QUERY, hint=str(e).partition("invalid-query:")[2].splitlines()[0].strip(), root=self.root)

    def answer(self, text: str, limit: int | None, raw: bool) -> Answer:
        df, columns, ev, info = self.evaluate(text, watch=True)
        most = limit if limit is not None else self.limits.rows
        rows = self.rendered(df, columns, raw) if columns else df.select()
        if columns:
            rows = rows.orderBy(*(F.col(c).cast("string") for c in rows.columns))
        got = [tuple(r) for r in (rows if most is None else rows.limit(most + 1)).collect()]
        ev.spend(ev.answered())
        for k in (columns.index(c) for c in info.pop("mixed")):
            got = [(*r[:k], int(r[k][2:]) if r[k][:2] == "i:" else r[k][2:], *r[k + 1 :]) for r in got]
        cap = None
        if most is not None and len(got) > most:
            got, cap = got[:most], "max_result_rows"
        if self.limits.bytes is not None:
            size = 0
            for k, r in enumerate(got):
                size += len(json.dumps(list(r), ensure_ascii=False).encode()) + 1
                if size > self.limits.bytes:
                    got, cap = got[:k], "max_result_bytes"
                    break
        status = Status.TRUNCATED if cap else Status.OK
        if set(info["depends"]) & schema.SCIP_ONLY and not self.scip_ingested:
            status = Status.NO_SCIP
        if self.stale:
            status = Status.STALE
        hint = f"cut at {cap}" if cap else "" if got else self.diagnose(text)
        return Answer(status, columns, got, bool(cap), cap, hint, self.root, {"derived": ev.derived, "rounds": ev.rounds, "demand": sorted(set(ev.seeded)), **info})

    def rendered(self, df: DataFrame, columns: list[str], raw: bool) -> DataFrame:
        """Symbols as `name path:line` of their first declaration, unless raw."""
        if raw or "def" not in self.base or "def_span" not in self.base:
            return df
        self.fill({"def", "def_span"})
        d, s = self.base["def"][0], self.base["def_span"][0]
        site = d.join(s.select(F.col("c0").alias("s0"), F.col("c1").alias("line")), F.col("c0") == F.col("s0"))
        site = site.groupBy("c0").agg(F.min(F.struct(F.col("c1").alias("f"), "line", F.col("c3").alias("n"))).alias("at"))
        for c in columns:
            if df.schema[c].dataType.simpleString() == "string":
                own = site.select(F.col("c0").alias("key_"), F.concat(F.col("at.n"), F.lit(" "), F.col("at.f"), F.lit(":"), F.col("at.line").cast("string")).alias("text_"))
                df = df.join(own, F.col(c) == F.col("key_"), "left").withColumn(c, F.coalesce("text_", c)).drop("key_", "text_")
        return df

    def diagnose(self, text: str) -> str:
        """For an empty answer: the first literal at which nothing is left, and constants that may be of the wrong type."""
        rules, goal, _, _ = self.plan(text)
        ev = Evaluation(self.spark, rules, self.base, self.limits.derived)
        for k in range(1, len(goal) + 1):
            if ev.goal(goal[:k]).df.limit(1).count() == 0:
                lit = goal[k - 1]
                name = getattr(lit, "name", None) or getattr(getattr(lit, "atom", None), "name", type(lit).__name__.lower())
                hint = f"nothing is left at literal {k} (`{name}`)"
                for a, t in zip(getattr(lit, "args", ()), ev.types.get(getattr(lit, "name", ""), ())):
                    if isinstance(a, Const) and (t == "int") != isinstance(a.value, int) and t != "mix":
                        hint += f"; {a.value!r} is {'a string' if isinstance(a.value, str) else 'an integer'}, and the column holds {'integers' if t == 'int' else 'strings'}"
                return hint
        return ""

    # -- what there is

    def catalog(self) -> dict:
        """Relations with their columns, rules with their lines of documentation, and vocabularies with counts."""
        self.fill({"file", "def", "visibility", "scip_ref"})
        vocabulary = {}
        for relation, k, what in (("file", 1, "languages"), ("def", 2, "kinds"), ("visibility", 1, "visibilities"), ("scip_ref", 5, "roles")):
            if relation in self.base:
                vocabulary[what] = {r[0]: r[1] for r in self.base[relation][0].groupBy(f"c{k}").count().orderBy(f"c{k}").collect()}
        return {"relations": {n: [f"{c}:{t}" for c, t in schema.RELATIONS[n]] if n in schema.RELATIONS else self.base[n][1] for n in sorted(self.base)}, "rules": {n: self.docs.get(n, (n, "")) for n in sorted({r.head.name for r in self.rules})}, "vocabulary": vocabulary}

    def census(self) -> dict[str, int]:
        self.fill()
        counts = [df.agg(F.count("*").alias("n")).withColumn("relation", F.lit(n)) for n, (df, _) in self.base.items()]
        return {r.relation: r.n for r in reduce(DataFrame.unionByName, counts).collect()} if counts else {}


def frame(spark: SparkSession, rows: list[tuple], types: list[str] | None = None) -> DataFrame:
    """Rows of constants as a DataFrame; a column of both integers and strings isn't allowed in a base relation."""
    types = types or ["int" if all(isinstance(r[k], int) for r in rows) else "str" for k in range(len(rows[0]))]
    for k, t in enumerate(types):
        if any(isinstance(r[k], int) != (t == "int") for r in rows):
            raise invalid(f"column {k} of a fact has values of the wrong type")
    return spark.createDataFrame(sorted(set(rows)), ", ".join(f"c{k} {'bigint' if t == 'int' else 'string'}" for k, t in enumerate(types)))
