"""What keeps memory, tasks and tables small on larger data."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tessera import driver_queries
from tessera.engine import Engine
from tessera.plans import compile as plans
from tessera.plans import evaluate, naive, tables
from tessera.plans.check import check
from tessera.plans.syntax import parse
from tessera.plans.tables import shared_dir
from tessera.sources import views

SF = "/root/testdata/sf0.001"


def test_pairs_of_few_keys_spread_over_many_tasks(spark, tmp_path, monkeypatch):
    """Two nations, one of them with most suppliers, and a row twice: brute force, and no task makes most of the pairs."""
    rows = [(k, k % 10 // 9) for k in range(300)]
    spark.createDataFrame([*rows, rows[7]], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(plans, "SIDE", 20, raising=False)
    df = driver_queries.queries()["join_self"](spark, str(tmp_path))
    got = [tuple(r) for r in df.collect()]
    assert sorted(got) == sorted((a, m, b) for a, m in rows for b, n in rows if m == n and a != b)
    parts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert max(parts) < len(got) / 5
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]  # duplicates go before the pairs are made


def test_lines_of_spans_are_made_in_many_tasks_and_once(spark):
    e = Engine(spark, code=True)
    facts = " ".join(f'def("s{k}", "a.rs", "struct", "S{k}"). def_span("s{k}", {k}, {k + 9}, 0, 9).' for k in range(40))
    e.load_facts(facts)
    for name in ("def", "def_span"):  # files, whose size Spark knows
        e.insert_relation(name, tables.materialize(e.base[name][0], name), trusted=True)
    df = e.dataframe("?- symbol_at(F, L, S).")
    assert {tuple(r) for r in df.collect()} == {("a.rs", line, f"s{k}") for k in range(40) for line in range(k, k + 10)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate")] and "Exchange" in plan  # lines are not dealt out, their spans are
    assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 2**40  # nobody takes them for small


def test_a_query_makes_what_it_reads_alone(spark, tmp_path):
    os.symlink(SF, tmp_path / "sf")
    at = shared_dir(spark).removeprefix("file://") + "/relations"
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    run = driver_queries.queries()["d07_local_def"]
    assert run(spark, str(tmp_path / "sf")).count() > 0
    new = {d.rpartition("-")[0] for d in set(os.listdir(at)) - before}
    assert "def" in new and not new & {"occ", "scip_ref", "name_ref", "def_span"}
    e = views.code(spark, str(tmp_path / "sf"))
    kept = e.base["def"][0]
    assert driver_queries.queries()["d05_scip_claim"](spark, str(tmp_path / "sf")).count() > 0
    assert e.base["def"][0] is kept and "name_ref" in e.waiting
    assert e.census()["name_ref"] > 0 and not e.waiting


def test_large_tables_are_not_sent_to_the_driver_by_the_size_of_their_files(spark, monkeypatch):
    monkeypatch.setattr(tables, "LARGE", 100, raising=False)
    rows = spark.range(1000).select(F.lit("the same").alias("c0"), F.col("id").alias("c1"))
    df, n = tables.counted(rows, "same")
    assert n == 1000 and df.count() == 1000 and df.columns == ["c0", "c1"]
    plan = spark.range(5).join(df.where("c1 < 900"), F.col("id") == F.col("c1"), "left_semi")
    assert "Broadcast" not in plan._jdf.queryExecution().sparkPlan().toString() and plan.count() == 5
    assert df.rdd.getNumPartitions() == tables.materialize(rows, "same").rdd.getNumPartitions()


def test_joins_of_many_new_rows_with_many_old_ones_have_tasks_by_their_rows(spark, monkeypatch):
    e = Engine(spark)
    e.load_facts(" ".join(f"next({k}, {k + 1})." for k in range(40)))
    monkeypatch.setattr(tables, "LARGE", 20, raising=False)
    plans, made = [], evaluate.counted

    def spy(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return made(df, name)

    monkeypatch.setattr(evaluate, "counted", spy)
    df = e.dataframe("far(A, B) :- next(A, B). far(A, C) :- far(A, B), far(B, C). ?- far(A, B).")
    assert {tuple(r) for r in df.collect()} == {(a, b) for a in range(41) for b in range(a + 1, 41)}
    dealt = [int(n) for text in plans for n in re.findall(r"RepartitionByExpression \[.*?\], (\d+)", text)]
    assert dealt and max(dealt) >= 500 // 20  # over 500 pairs are there in the last round but one


USES = 'call("ada", "f", 3). call("ada", "g", 4). call("box", "f", 5). call("box", "h", 5). kind("f", "fun"). kind("g", "mod"). kind("ada", "fun"). kind("box", "mod"). sure("f", 3). '
USE = 'use(S, W, L, "sure") :- call(W, S, L), sure(S, L). use(S, W, L, "name") :- call(W, S, L), !sure(S, L). '


@pytest.mark.parametrize("rules, want", [
    ('edge(W, S) :- use(S, W, _, _), kind(S, K), K = "fun", kind(W, J), J != "mod". ?- edge(W, S).', {("ada", "f")}),
    ('edge(W, S) :- use(S, W, _, "name"). ?- edge(W, S).', {("ada", "g"), ("box", "f"), ("box", "h")}),
    ('edge(W, P) :- use(_, W, 5, P). ?- edge(W, P).', {("box", "name")}),
    ('same(W) :- use(W, W, _, _). ?- same(W).', set()),
    ('edge(W, N) :- kind(W, _), N = count{ S : use(S, W, _, _) }. ?- edge(W, N).', {("ada", 2), ("box", 2), ("f", 0), ("g", 0)}),
    ('free(S) :- kind(S, _), !use(S, _, _, _). ?- free(S).', {("ada",), ("box",)}),
])
def test_parts_of_a_predicate_are_read_from_its_clauses(spark, rules, want):
    text = USES + USE + rules
    clauses, goal = check(parse(text), {})
    df, columns, ev, _ = Engine(spark).evaluate(text)
    assert {tuple(r) for r in df.collect()} == want == naive.answer(clauses, goal, {})


def test_calls_are_not_made_from_whole_references(spark):
    """Of the references, those from no callable place go before anything else is joined; no distinct over all seven columns."""
    e = Engine(spark, code=True)
    e.load_facts('def("s", "a.rs", "function", "S"). def("t", "a.rs", "function", "T"). name_ref("S", "a.rs", 3, 4, "t"). name_ref("S", "a.rs", 5, 4, "a.rs"). scip_ref("t", "a.rs", 9, 1, "s", "read").')
    df = e.dataframe("?- calls(A, B).")
    assert {tuple(r) for r in df.collect()} == {("t", "s"), ("s", "t")}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    wide = [line for line in plan.splitlines() if "Aggregate [" in line and line.split("Aggregate [")[1].split("]")[0].count(",") > 3]
    assert not wide
