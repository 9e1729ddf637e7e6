"""Clause bodies as DataFrames: literals become filters, joins, anti joins, aggregates and generators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import invalid
from tessera.functions.regex import checked
from tessera.plans.syntax import MOST_INT, Arith, Assign, Atom, Between, Compare, Const, Count, Not, Test, Var, Wild, variables
from tessera.plans.types import INT, MIX, STR, convert, equal, literal

#: Of an atom, its index in the body, the environment so far: its rows with columns c0, c1, ... and their types.
Resolve = Callable[[Atom, object, "Env"], tuple[DataFrame, list[str]]]

SIDE = 2_000  # rows of a block


def name_of(variable: str) -> str:
    return "v_" + variable.replace(".", "__")


class Env:
    """The bindings so far: a DataFrame with a column for each bound variable. df is None before the first literal.

    unique: no two rows are alike, which needs no look at them."""

    def __init__(self, df: DataFrame | None, types: dict[str, str], narrowed: bool = False, unique: bool = False):
        self.df, self.types, self.narrowed, self.unique = df, types, narrowed, unique

    def col(self, v: str) -> Column:
        return F.col(name_of(v))


class BodyCompiler:
    def __init__(self, spark: SparkSession, resolve: Resolve, kept=(), is_set: Callable[[str], bool] = lambda name: False, pairs: bool = False, parts: Callable[[str], int] = lambda name: 0):
        """kept: variables that the head keeps. is_set: whether a predicate's rows are known to differ. pairs: of a body
        whose rows are all kept, duplicates go before the joins, and joins of few keys are dealt out in blocks. parts: into
        how many partitions a join with a predicate is dealt out at least, where not 0."""
        self.spark, self.resolve, self.kept, self.is_set, self.pairs, self.parts = spark, resolve, set(kept), is_set, pairs, parts

    def unit(self, env: Env) -> Env:
        return env if env.df is not None else Env(self.spark.range(1).select(F.lit(True).alias("unit")), env.types, env.narrowed, True)

    def tasks(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def run(self, body, env: Env | None = None, first: int | None = None) -> Env:
        """Joins connected literals first, and runs whatever filters as soon as its variables are bound.

        first: index of the literal to begin with (the rows that are new in a round)."""
        env = env or Env(None, {})
        todo = list(enumerate(body))
        if first is not None:
            env = self.step(first, body[first], env)
            todo = [x for x in todo if x[0] != first]
        while todo:
            ready = next((x for x in todo if isinstance(x[1], (Compare, Test)) and self.ready(x[1], env)), None)
            ready = ready or next((x for x in todo if self.restricts(x[1], env, todo)), None)
            ready = ready or next((x for x in todo if self.ready(x[1], env)), None)
            if ready is None:
                atoms = [x for x in todo if isinstance(x[1], Atom)]
                if not atoms:
                    ready = next((x for x in todo if self.ready(x[1], env, last=True)), None)
                    if ready is None:
                        raise invalid("a literal's variables are never bound")
                else:
                    ready = max(atoms, key=lambda x: (self.links(x[1], env), -x[0]))
            env = self.step(*ready, env)
            todo.remove(ready)
        return self.unit(env)

    @staticmethod
    def links(a: Atom, env: Env) -> tuple:
        bound = sum(isinstance(t, Const) or isinstance(t, Var) and t.name in env.types for t in a.args)
        shared = any(isinstance(t, Var) and t.name in env.types for t in a.args)
        return (shared or env.df is None, bound)

    @staticmethod
    def restricts(a, env: Env, todo: list) -> bool:
        """A linked atom whose other variables only filter: it takes rows away before anti joins see them."""
        if env.df is None or not isinstance(a, Atom) or not any(isinstance(t, Var) and t.name in env.types for t in a.args):
            return False
        new, rest = {t.name for t in a.args if isinstance(t, Var)} - set(env.types), [x for _, x in todo if x is not a]
        filters = [x for x in rest if isinstance(x, (Compare, Test)) or isinstance(x, Atom) and len(x.args) == 1]
        return bool(new) and all(any(v in variables(x) for x in filters) and not any(v in variables(x) for x in rest if x not in filters) for v in new)

    @staticmethod
    def ready(lit, env: Env, last: bool = False) -> bool:
        known = lambda ts: all(not isinstance(t, Var) or t.name in env.types for t in ts)
        match lit:
            case Not():
                return known(lit.atom.args)
            case Compare():
                return known([lit.left, lit.right])
            case Test():
                return known([lit.subject])
            case Between():  # a generator waits until nothing else can bind its output
                return known([lit.low, lit.high]) and (last or known([lit.out]))
            case Assign(expr=Count() as c):
                return all(k in env.types for k in c.keys) and (last or known([lit.var]) or bool(c.keys) or env.df is None)
            case Assign(expr=Arith() as a):
                return known([a.left, a.right])
            case Assign():
                return known([lit.expr])
        return False

    def step(self, i, lit, env: Env) -> Env:
        match lit:
            case Atom():
                return self.positive(i, lit, env)
            case Not():
                return self.negative(i, lit.atom, env)
            case Compare():
                return self.where(env, self.compare(lit, env))
            case Test():
                return self.where(env, self.test(lit, env))
            case Between():
                return self.between(lit, env)
            case Assign(expr=Count() as c):
                return self.count(lit.var.name, c, env)
            case Assign():
                return self.assign(lit.var.name, *self.value(lit.expr, env), env)
        raise AssertionError(lit)

    def where(self, env: Env, condition: Column) -> Env:
        env = self.unit(env)
        return Env(env.df.where(condition), env.types, env.narrowed, env.unique)

    def matched(self, a: Atom, df: DataFrame, types: list[str]) -> tuple[DataFrame, dict[str, str]]:
        """The rows that agree with an atom's constants and repeated variables, with a column r_X for each variable X."""
        seen: dict[str, int] = {}
        for k, t in enumerate(a.args):
            if isinstance(t, Const):
                c = literal(t.value, types[k])
                df = df.where(F.lit(False) if c is None else F.col(f"c{k}") == c)
            elif isinstance(t, Var):
                if t.name in seen:
                    df = df.where(equal(F.col(f"c{seen[t.name]}"), types[seen[t.name]], F.col(f"c{k}"), types[k]))
                else:
                    seen[t.name] = k
        return df.select(*(F.col(f"c{k}").alias("r_" + name_of(v)) for v, k in seen.items())), {v: types[k] for v, k in seen.items()}

    def positive(self, i, a: Atom, env: Env) -> Env:
        df, types = self.matched(a, *self.resolve(a, i, env))
        right = lambda v: F.col("r_" + name_of(v))
        constant = env.narrowed or any(isinstance(t, Const) for t in a.args)
        unique = self.is_set(a.name) and not any(isinstance(t, Wild) for t in a.args)
        if self.pairs and not unique:
            df, unique = df.distinct(), True
        if env.df is None:
            if not types:
                return Env(self.unit(env).df.join(df.withColumn("r_", F.lit(1)), F.lit(True), "left_semi"), {}, constant, True)
            return Env(df.select(*(right(v).alias(name_of(v)) for v in types)), types, constant, unique)
        shared, new = [v for v in types if v in env.types], [v for v in types if v not in env.types]
        on = F.lit(True)
        for k, v in enumerate(shared):
            same = equal(env.col(v), env.types[v], right(v), types[v])
            on = same if not k else on & same
        if not new:
            return Env(env.df.join(df if shared else df.withColumn("r_", F.lit(1)), on, "left_semi"), env.types, constant, env.unique)
        keep = [F.col(c) for c in env.df.columns if c != "unit"]
        blocks = self.blocks(env, df, shared) if self.pairs and shared and all(env.types[v] == types[v] for v in shared) else None
        if blocks:
            left, df, block = blocks
            out = left.join(df, on & block)
        elif (n := self.parts(a.name)) and shared and all(env.types[v] == types[v] for v in shared):
            n = max(n, self.tasks())
            out = env.df.repartition(n, *map(env.col, shared)).join(df.repartition(n, *map(right, shared)), on)
        else:
            out = env.df.join(df, on) if shared else env.df.crossJoin(df)
        return Env(out.select(*keep, *(right(v).alias(name_of(v)) for v in new)), env.types | {v: types[v] for v in new}, constant, env.unique and unique)

    def blocks(self, env: Env, df: DataFrame, shared: list[str]) -> tuple[DataFrame, DataFrame, Column] | None:
        """Both sides of a join whose rows are many times its input's, so that they spread over all tasks: the rows of a
        key with many pairs go to blocks of SIDE rows on each side, each of which meets each of the other side's in a group of
        its own. None where the pairs are few."""
        of_left, of_right = [name_of(v) for v in shared], ["r_" + name_of(v) for v in shared]
        n = env.df.groupBy(*of_left).agg(F.count("*").alias("nl_")).join(
            df.groupBy(*of_right).agg(F.count("*").alias("nr_")), [F.col(x) == F.col(y) for x, y in zip(of_left, of_right)]
        )
        total = n.agg(F.sum(F.col("nl_") * F.col("nr_"))).first()[0] or 0
        if total < 4 * SIDE * SIDE:
            return None
        n = n.where(F.col("nl_") * F.col("nr_") > SIDE * SIDE).select(
            *(F.col(c).alias(f"k{i}_") for i, c in enumerate(of_left)), F.ceil(F.col("nl_") / SIDE).alias("lefts"), F.ceil(F.col("nr_") / SIDE).alias("rights")
        )
        many = max(self.tasks(), total // (4 * SIDE * SIDE))

        def dealt(side: DataFrame, keys: list[str], own: str, other: str, mark: str) -> DataFrame:
            block = F.pmod(F.xxhash64(*side.columns), F.coalesce(own, F.lit(1)))
            each = F.sequence(F.lit(0).cast("bigint"), F.coalesce(other, F.lit(1)) - 1)
            out = side.join(n, [F.col(k) == F.col(f"k{i}_") for i, k in enumerate(keys)], "left")
            out = out.select(*side.columns, block.alias(f"{mark}{own}_"), F.explode(each).alias(f"{mark}{other}_"))
            return out.repartition(many, *keys, f"{mark}lefts_", f"{mark}rights_")

        left, right = dealt(env.df, of_left, "lefts", "rights", "l"), dealt(df, of_right, "rights", "lefts", "r")
        return left, right.hint("merge"), (F.col("llefts_") == F.col("rlefts_")) & (F.col("lrights_") == F.col("rrights_"))

    def negative(self, i, a: Atom, env: Env) -> Env:
        env = self.unit(env)
        df, types = self.matched(a, *self.resolve(a, ("not", i), env))
        on = F.lit(True)
        for k, v in enumerate(types):
            same = equal(env.col(v), env.types[v], F.col("r_" + name_of(v)), types[v])
            on = same if not k else on & same
        return Env(env.df.join(df if types else df.withColumn("r_", F.lit(1)), on, "left_anti"), env.types, env.narrowed, env.unique)

    def operand(self, t, env: Env) -> tuple[Column, str]:
        if isinstance(t, Const):
            kind = INT if isinstance(t.value, int) else STR
            return literal(t.value, kind), kind
        return env.col(t.name), env.types[t.name]

    def number(self, t, env: Env, op: str) -> Column:
        c, kind = self.operand(t, env)
        if kind == STR:  # an error only if a row gets there
            return F.raise_error(F.lit(f"invalid-query: `{op}` needs integers, and {t.name if isinstance(t, Var) else t.value!r} is a string")).cast("bigint")
        return c if kind == INT else F.coalesce(convert(c, MIX, INT), F.raise_error(F.lit(f"invalid-query: `{op}` needs integers")).cast("bigint"))

    def compare(self, lit: Compare, env: Env) -> Column:
        if lit.op in ("=", "!="):
            same = equal(*self.operand(lit.left, env), *self.operand(lit.right, env))
            return same if lit.op == "=" else ~same
        a, b = self.number(lit.left, env, lit.op), self.number(lit.right, env, lit.op)
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[lit.op]

    def test(self, lit: Test, env: Env) -> Column:
        c, kind = self.operand(lit.subject, env)
        java = checked(self.spark, lit.pattern) if lit.kind == "match" else None
        if kind == INT:
            return F.lit(False)
        c = convert(c, kind, STR)
        found = c.rlike(java) if java else {"prefix": c.startswith, "suffix": c.endswith, "contains": c.contains}[lit.kind](lit.pattern)
        return F.coalesce(found, F.lit(False)) if kind == MIX else found

    def value(self, e, env: Env) -> tuple[Column, str]:
        if not isinstance(e, Arith):
            return self.operand(e, env)
        a, b = self.number(e.left, env, e.op), self.number(e.right, env, e.op)
        fail = lambda text: F.raise_error(F.lit(f"invalid-query: {text}")).cast("bigint")
        if e.op == "/":
            return F.when(b == 0, fail("division by zero")).otherwise(F.floor(a / F.nullif(b, F.lit(0).cast("bigint"))).cast("bigint")), INT
        r = {"+": a + b, "-": a - b, "*": a * b}[e.op]
        return F.when(r.between(0, MOST_INT), r).otherwise(fail(f"a result of `{e.op}` is outside 0..{MOST_INT}")), INT

    def assign(self, v: str, c: Column, kind: str, env: Env) -> Env:
        env = self.unit(env)
        if v in env.types:
            return self.where(env, equal(env.col(v), env.types[v], c, kind))
        return Env(env.df.withColumn(name_of(v), c), env.types | {v: kind}, env.narrowed, env.unique)

    def between(self, lit: Between, env: Env) -> Env:
        env = self.unit(env)
        low, high, v = self.number(lit.low, env, "between"), self.number(lit.high, env, "between"), getattr(lit.out, "name", None)
        if v is None:
            return self.where(env, F.lit(False) if isinstance(lit.out.value, str) else F.lit(lit.out.value).between(low, high))
        if v in env.types:
            if env.types[v] == STR:
                return self.where(env, F.lit(False))
            return self.where(env, F.coalesce(convert(env.col(v), env.types[v], INT).between(low, high), F.lit(False)))
        df = env.df.where(low <= high)  # sequence() would count down
        # spans of few bytes give many rows: they are dealt out before, in a number that AQE leaves alone
        if env.types:
            df = df.repartition(self.tasks(), *([env.col(x) for x in env.types if x in self.kept] or df.columns))
        return Env(df.withColumn(name_of(v), F.explode(F.sequence(low, high))), env.types | {v: INT}, env.narrowed, env.unique)

    def count(self, v: str, c: Count, env: Env) -> Env:
        env = self.unit(env)
        keys = [name_of(k) for k in c.keys]
        outer = Env(env.df.select(*keys).distinct(), {k: env.types[k] for k in c.keys}, env.narrowed, True) if keys else None
        inner = self.run(c.goal, outer)
        term = self.operand(c.term, inner)[0]
        counted = inner.df.groupBy(*keys).agg(F.count_distinct(term).alias("n_"))
        if keys:
            right = counted.select(*(F.col(k).alias(f"k_{k}") for k in keys), "n_")
            on = F.lit(True)
            for j, k in enumerate(keys):
                on = (F.col(k) == F.col(f"k_{k}")) if not j else on & (F.col(k) == F.col(f"k_{k}"))
            df = env.df.join(right, on, "left").select(*env.df.columns, F.coalesce("n_", F.lit(0)).cast("bigint").alias("n_"))
        else:
            df = env.df.crossJoin(counted)
        return Env(self.assign(v, F.col("n_"), INT, Env(df, env.types, env.narrowed)).df.drop("n_"), env.types | ({} if v in env.types else {v: INT}), env.narrowed, env.unique)

    def head(self, a: Atom, env: Env, types: list[str]) -> DataFrame:
        """The head's columns c0, c1, ..., of the relation's types."""
        out = []
        for k, t in enumerate(a.args):
            c, kind = self.operand(t, env)
            out.append(convert(c, kind, types[k]).alias(f"c{k}"))
        return env.df.select(*out)

