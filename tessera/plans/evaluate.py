"""Evaluation: lazy DataFrames for what isn't recursive, semi-naive rounds with demand seeds for what is."""

from __future__ import annotations

import time
from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import QueryError, Status
from tessera.plans import tables
from tessera.plans.check import components, is_recursive
from tessera.plans.compile import BodyCompiler, Env
from tessera.plans.syntax import Assign, Atom, Between, Const, Rule, Var, Wild, atoms, goal_columns, map_terms, variables
from tessera.plans.tables import counted, materialize, observed, unsized
from tessera.plans.types import convert, infer

COMPACT = 8  # rounds after which the deltas so far become one table
SHARED = 3  # a joined predicate with so many uses is computed once and written


class Evaluation:
    """Of one program: rules and base relations (columns c0, c1, ... and their types)."""

    def __init__(self, spark: SparkSession, rules: list[Rule], base: dict[str, tuple[DataFrame, list[str]]], most_derived: int | None = None, deadline: float | None = None, seeds: bool = True, warm: dict | None = None):
        """warm: finished predicates of an earlier evaluation of the same rules over the same relations; grows."""
        self.spark, self.rules, self.base, self.use_seeds = spark, rules, dict(base), seeds
        self.types = infer(rules, {k: v[1] for k, v in base.items()})
        self.part = {n: p for p in components(rules) for n in p}
        self.recursive = {n for n, p in self.part.items() if is_recursive(p, rules)}
        self.done: dict[tuple, tuple[DataFrame, list[str]]] = {}
        self.warm = {} if warm is None else warm
        used = Counter(a.name for r in rules for a, _ in atoms(r.body))
        self.wide = {r.head.name for r in rules if sum(1 for _ in atoms(r.body)) > 1}
        while more := {r.head.name for r in rules if any(a.name in self.wide for a, _ in atoms(r.body))} - self.wide:
            self.wide |= more  # what is made of such predicates
        self.shared = {n for n in self.wide if used[n] >= SHARED and n not in self.recursive}
        self.most_derived, self.deadline, self.derived, self.rounds, self.seeded = most_derived, deadline, 0, 0, []
        self.fresh, self.answer = 0, None
        self.rules = [x for r in rules for x in self.unfold(r)]

    def unfold(self, r: Rule) -> list[Rule]:
        """The clause with clauses of what it uses in place of an atom that keeps a part of the columns alone: whole rows of
        that predicate would be made distinct for nothing, and before what else the clause asks for takes most of them away."""
        if r.head.name in self.recursive:
            return [r]
        for i, a in enumerate(r.body):
            if not isinstance(a, Atom) or a.name not in self.wide - self.recursive - self.shared or not any(isinstance(t, Wild) for t in a.args) or (a.name, (None,) * len(a.args)) in self.warm:
                continue
            self.fresh += 1
            put = [inlined(r, i, c, f".u{self.fresh}") for c in self.rules_of({a.name})]
            if None not in put:
                return [y for x in put for z in x for y in self.unfold(z)]
        return [r]

    def empty(self, name: str) -> DataFrame:
        kinds = ", ".join(f"c{i} {'bigint' if t == 'int' else 'string'}" for i, t in enumerate(self.types[name]))
        return self.spark.createDataFrame([], kinds)

    def rules_of(self, names) -> list[Rule]:
        return [r for r in self.rules if r.head.name in names]

    def goal(self, body) -> Env:
        whole = [x.name in self.base and not any(isinstance(t, Wild) for t in x.args) for x in body if isinstance(x, Atom)]
        return BodyCompiler(self.spark, self.resolve, goal_columns(body), lambda name: name not in self.base, len(whole) > 1 and all(whole)).run(body)

    def resolve(self, a: Atom, at, env: Env) -> tuple[DataFrame, list[str]]:
        """The rows of a predicate, of those that the atom's constants and, for recursive ones, bindings ask for."""
        if a.name in self.base:
            return self.base[a.name]
        consts = tuple(t if isinstance(t, Const) else None for t in a.args)
        if a.name not in self.recursive:
            return self.instance(a.name, consts)
        bound = [k for k, t in enumerate(a.args) if isinstance(t, Const) or isinstance(t, Var) and env.narrowed and env.df is not None and t.name in env.types]
        if self.use_seeds and bound and not isinstance(at, tuple):
            found = self.from_seeds(a, bound, env)
            if found is not None:
                return found
        return self.closure(a.name)

    def instance(self, name: str, consts: tuple, keep: bool = False) -> tuple[DataFrame, list[str]]:
        """A predicate without recursion, with its constants put into its clauses, so that they reach every scan.

        What is used often, or kept for the rounds of a fixpoint, is written: as a whole where nothing is bound, else
        what the constants leave of it."""
        none = (None,) * len(consts)
        for key in ((name, none), (name, consts)):
            if key in self.warm:
                return self.warm[key]  # finished as a whole, or with the same constants
        written = name in self.shared or keep
        if key not in self.done or written:
            rules = [r for r in (specialize(r, consts) for r in self.rules_of({name})) if r]
            df = reduce(DataFrame.unionByName, map(self.clause, rules)).distinct() if rules else self.empty(name)
            if written:
                df, n = counted(df, name)
                self.spend(n)
                self.warm[key] = df, self.types[name]
            elif any(isinstance(x, Between) and isinstance(x.out, Var) for r in rules for x in r.body):
                df = unsized(df)  # many times the rows from which Spark would guess its size
            self.done[key] = df, self.types[name]
        return self.done[key]

    def clause(self, r: Rule, resolve=None, first: int | None = None, parts=lambda name: 0) -> DataFrame:
        c = BodyCompiler(self.spark, resolve or self.resolve, variables(r.head), parts=parts)
        return c.head(r.head, c.run(r.body, first=first), self.types[r.head.name])

    def invariant(self, a: Atom, at, env: Env) -> tuple[DataFrame, list[str]]:
        """What every round of a fixpoint reads and none changes: joins are done once and written, not planned anew each round."""
        if a.name in self.base or a.name in self.recursive:
            return self.resolve(a, at, env)
        return self.instance(a.name, tuple(t if isinstance(t, Const) else None for t in a.args), keep=True)

    def closure(self, name: str) -> tuple[DataFrame, list[str]]:
        if (name, "all") in self.warm:
            return self.warm[name, "all"]
        if (name, "all") not in self.done:
            part = self.part[name]
            for n, df in self.fixpoint(part, self.rules_of(part)).items():
                self.done[n, "all"] = self.warm[n, "all"] = df, self.types[n]
        return self.done[name, "all"]

    def fixpoint(self, part: list[str], rules: list[Rule]) -> dict[str, DataFrame]:
        """Rounds in which only rows that are new in the last one are joined, in each recursive place in turn."""
        inside = set(part)
        kept: dict[str, list[DataFrame]] = {n: [] for n in part}
        everything = lambda n: reduce(DataFrame.unionByName, kept[n]) if kept[n] else self.empty(n)
        delta: dict[str, DataFrame | None] = dict.fromkeys(part)
        held, size_of = Counter(), Counter()  # rows so far, and of the last round
        for r in rules:  # before the first round, which may read the same
            if any(isinstance(x, Atom) and x.name in inside for x in r.body):
                for i, x in enumerate(r.body):
                    if isinstance(x, Atom) and x.name not in inside | self.recursive and x.name not in self.base:
                        self.invariant(x, i, Env(None, {}))
        for step in range(10**6):
            made: dict[str, list[DataFrame]] = {n: [] for n in part}
            for r in rules:
                places = [i for i, lit in enumerate(r.body) if isinstance(lit, Atom) and lit.name in inside]
                if not places and not step:
                    made[r.head.name].append(self.clause(r))
                for place in places if step else []:
                    if delta[r.body[place].name] is None:
                        continue

                    def rows(a, at, env, place=place):
                        if a.name not in inside:
                            return self.invariant(a, at, env)
                        return (delta[a.name] if at == place else everything(a.name)), self.types[a.name]

                    # many new rows that meet many old ones: by the bytes of both AQE would join them in few tasks
                    many = size_of[r.body[place].name] > tables.LARGE
                    made[r.head.name].append(self.clause(r, rows, place, lambda name, many=many: -(-held[name] // tables.LARGE) if many and name in inside else 0))
            fresh: dict[str, DataFrame | None] = dict.fromkeys(part)
            for n in part:
                if not made[n]:
                    continue
                new = reduce(DataFrame.unionByName, made[n]).distinct()
                if kept[n]:
                    old = everything(n).select(*(F.col(c).alias(f"o{c}") for c in new.columns))
                    new = new.join(old, reduce(lambda x, y: x & y, (F.col(c) == F.col(f"o{c}") for c in new.columns)), "left_anti")
                new, size = counted(new, n.replace("@", "_"))
                self.spend(size)
                held[n] += size
                size_of[n] = size
                if size:
                    fresh[n] = new
            self.rounds += 1
            for n, df in fresh.items():
                if df is not None:
                    kept[n].append(df)
                    if len(kept[n]) > COMPACT:
                        kept[n] = [counted(everything(n), n.replace("@", "_"))[0]]
            delta = fresh
            if not any(df is not None for df in fresh.values()):
                return {n: everything(n) for n in part}
        raise AssertionError

    def spend(self, rows: int) -> None:
        self.derived += rows
        if self.most_derived is not None and self.derived > self.most_derived:
            raise QueryError(Status.BUDGET_EXCEEDED, f"more than {self.most_derived} tuples derived")
        if self.deadline is not None and time.monotonic() > self.deadline:
            raise QueryError(Status.TIMEOUT, "the time is over")

    def answered(self) -> int:
        """Rows of the goal's body, once its answer has been computed."""
        return (observed(self.answer) or 0) if self.answer is not None else 0

    def from_seeds(self, a: Atom, bound: list[int], env: Env) -> tuple[DataFrame, list[str]] | None:
        """The part of a recursive predicate that the bound places ask for, by magic sets; None where they can't be passed on."""
        name = a.name
        if len(self.part[name]) > 1:
            return None
        consts = [k for k in bound if isinstance(a.args[k], Const)]
        key = (name, "seeds", tuple((k, a.args[k]) for k in consts))
        only_constants = len(consts) == len(bound)
        if only_constants and key in self.done:
            return self.done[key]
        plan = demand(name, bound, self.rules_of({name}))
        if plan is None and consts and not only_constants:
            bound, only_constants = consts, True
            plan = demand(name, bound, self.rules_of({name}))
        if plan is None:
            return None
        magic_rules, guarded = plan
        self.fresh += 1
        seed, magic = f"seed@{name}@{self.fresh}", f"magic@{name}@{self.fresh}"
        kinds = [self.types[name][k] for k in bound]
        columns = []
        for j, k in enumerate(bound):
            t = a.args[k]
            if isinstance(t, Const):
                kind = "int" if isinstance(t.value, int) else "str"
                c = convert(F.lit(t.value).cast("bigint" if kind == "int" else "string"), kind, kinds[j])
            else:
                c = convert(env.col(t.name), env.types[t.name], kinds[j])
            if c is None:
                return self.empty(name), self.types[name]
            columns.append(c.alias(f"c{j}"))
        df = self.spark.range(1).select(*columns) if only_constants else env.df.select(*columns).distinct()
        self.base[seed] = materialize(df, "seed"), kinds
        self.types[seed] = self.types[magic] = kinds
        own = tuple(Var(f"M{j}") for j in range(len(bound)))
        if magic_rules:
            rules = [Rule(Atom(magic, own), (Atom(seed, own),))]
            rules += [Rule(Atom(magic, h.args), tuple(Atom(magic, x.args) if isinstance(x, Atom) and x.name == "magic" else x for x in b)) for h, b in magic_rules]
            self.base[magic] = self.fixpoint([magic], rules)[magic], kinds
        else:
            self.base[magic] = self.base[seed]
        rules = [Rule(r.head, tuple(Atom(magic, x.args) if isinstance(x, Atom) and x.name == "magic" else x for x in r.body)) for r in guarded]
        out = self.fixpoint([name], rules)[name], self.types[name]
        self.seeded.append(name)
        if only_constants:
            self.done[key] = out
        return out


def specialize(r: Rule, consts: tuple) -> Rule | None:
    """The clause with constants for the variables of its head; None if it can't give them. The head keeps the constants."""
    to: dict[str, Const] = {}
    for t, c in zip(r.head.args, consts):
        if c is None:
            continue
        if isinstance(t, Const) and t != c or isinstance(t, Var) and to.get(t.name, c) != c:
            return None
        if isinstance(t, Var):
            to[t.name] = c
    if not to or not all(substitutable(x, to) for x in r.body):
        return r
    put = lambda t: to.get(t.name, t) if isinstance(t, Var) else t
    return Rule(map_terms(r.head, put), tuple(map_terms(x, put) for x in r.body))


def inlined(r: Rule, i: int, c: Rule, mark: str) -> list[Rule] | None:
    """The clause with the body of c, a clause of that predicate, in place of its i-th literal: none if constants differ; None
    if that can't be written. mark sets the variables of c apart."""
    own = lambda t: Var(t.name + mark) if isinstance(t, Var) else t
    c = Rule(map_terms(c.head, own), tuple(map_terms(x, own) for x in c.body))
    inner, outer = {}, {}
    for t, h in zip(r.body[i].args, c.head.args):
        if isinstance(t, Wild):
            continue
        to, key, value = (inner, h, t) if isinstance(h, Var) else (outer, t, h)
        if isinstance(key, Const):
            if key != value:
                return []
        elif to.setdefault(key.name, value) != value:
            return None
    if not all(substitutable(x, inner) for x in c.body) or not all(substitutable(x, outer) for x in r.body):
        return None
    put = lambda to: lambda t: to.get(t.name, t) if isinstance(t, Var) else t
    body = (*r.body[:i], *(map_terms(x, put(inner)) for x in c.body), *r.body[i + 1 :])
    return [Rule(map_terms(r.head, put(outer)), tuple(map_terms(x, put(outer)) for x in body))]


def substitutable(x, to: dict) -> bool:
    """Constants can stand in place of these variables there: not where a variable is assigned."""
    return not (isinstance(x, Assign) and set(variables(x)) & set(to))


def demand(name: str, bound: list[int], rules: list[Rule]) -> tuple[list[tuple[Atom, tuple]], list[Rule]] | None:
    """Magic rules (head, body) and guarded clauses for calls with these places bound; `magic` stands for the magic predicate.

    A recursive call's bound arguments have to come from the head's and from literals that aren't recursive."""
    magic_rules, guarded = [], []
    for r in rules:
        hb = tuple(r.head.args[k] for k in bound)
        guard = Atom("magic", hb)
        guarded.append(Rule(r.head, (guard, *r.body)))
        plain = [x for x in r.body if isinstance(x, Atom) and x.name != name]
        for call in (x for x in r.body if isinstance(x, Atom) and x.name == name):
            cb = tuple(call.args[k] for k in bound)
            if cb == hb:
                continue
            have, used, grown = set(variables(guard)), [], True
            while grown and not all(isinstance(t, Const) or isinstance(t, Var) and t.name in have for t in cb):
                grown = False
                for x in plain:
                    if x not in used and set(variables(x)) & have:
                        used.append(x)
                        have |= set(variables(x))
                        grown = True
            if any(isinstance(t, Wild) or isinstance(t, Var) and t.name not in have for t in cb):
                return None
            magic_rules.append((Atom("magic", cb), (guard, *used)))
    return magic_rules, guarded

