"""Source trees to facts, the store, and the command line over it."""

import io
import json
import os

import pytest

from tessera.__main__ import Service, main, respond, schema_text, serve
from tessera.errors import QueryError, Status
from tessera.operators.sweep import owners
from tessera.sources.python_facts import facts
from tessera.sources.tree import walk
from tessera.store import Store, discover

SHAPES = '''"""Shapes."""
from __future__ import annotations
import math as m, os.path
from ..base import Thing

UNIT = "é"; NEXT: int = 2


@register
@cached(size=3)
class Circle(Thing):
    """A circle.

      Indented more.
    """

    radius: float = 1.0

    def area(self, scale=lambda x: x) -> float:  # how large
        def square(x):
            return x * x
        return m.prod([square(self.radius)])

    async  def _grow(self,
                     by: dict[str, int] = {"a": 1}):
        self.radius = grown(self.radius)
'''


def by_relation(rows):
    out = {}
    for r, s, n in rows:
        out.setdefault(r, set()).add((*s, *n))
    return out


def test_facts_of_a_python_file():
    got = by_relation(facts("lib/shapes.py", SHAPES)[0])
    p = "local lib/shapes.py "
    assert got["def"] == {
        (p + "UNIT.", "lib/shapes.py", "variable", "UNIT"), (p + "NEXT.", "lib/shapes.py", "variable", "NEXT"), (p + "Circle#", "lib/shapes.py", "class", "Circle"), (p + "Circle#radius.", "lib/shapes.py", "field", "radius"),
        (p + "Circle#area().", "lib/shapes.py", "method", "area"), (p + "Circle#area().square().", "lib/shapes.py", "function", "square"), (p + "Circle#_grow().", "lib/shapes.py", "method", "_grow"),
    }
    assert got["import"] == {("lib/shapes.py", "math", "m"), ("lib/shapes.py", "os.path", ""), ("lib/shapes.py", "..base", "")}
    lines = SHAPES.split("\n")
    assert (p + "Circle#", 9, 26, SHAPES.encode().index(b"@register"), len(SHAPES.encode()) - 1) in got["def_span"]
    assert (p + "NEXT.", 6, len('UNIT = "é"; '.encode())) in got["def_name"] and (p + "Circle#_grow().", 24, 15) in got["def_name"]
    sigs = {s: t for s, t in got["def_sig"]}
    assert sigs[p + "Circle#"] == "class Circle(Thing)" and sigs[p + "Circle#area()."] == "def area(self, scale=lambda x: x) -> float" and sigs[p + "Circle#_grow()."] == 'async def _grow(self, by: dict[str, int] = {"a": 1})'
    assert got["def_doc"] == {(p + "Circle#", "A circle.\n\nIndented more.")}
    assert {(s, v) for s, v in got["visibility"] if v == "restricted"} == {(p + "Circle#_grow().", "restricted")}
    assert (p + "Circle#area().square().", p + "Circle#area().") in got["parent"] and (p + "Circle#", "lib/shapes.py") in got["parent"]
    at = lambda line, text: (line, len(lines[line - 1].partition(text)[0].encode()))
    refs = {(name, line, col): src for name, _, src, line, col in got["name_ref"]}
    assert refs == {("cached", *at(10, "cached")): "lib/shapes.py", ("prod", *at(22, "prod")): p + "Circle#area().", ("square", *at(22, "square")): p + "Circle#area().", ("grown", *at(26, "grown")): p + "Circle#_grow()."}
    assert facts("bad.py", "x = (\n") == ([("file", ["bad.py", "python"], [])], 1)
    assert facts("empty.py", "") == ([("file", ["empty.py", "python"], [])], None)


@pytest.mark.parametrize("spans, want", [
    ([(5, 9), (0, 20), (4, 10), (12, 12)], [2, None, 1, 1]), ([(3, 8), (3, 8), (3, 8)], [None, 0, 1]), ([(0, 4), (4, 9)], [None, None]), ([(0, 6), (4, 9), (5, 6)], [None, 0, 1]), ([], []),
])
def test_owners_of_spans(spans, want):
    assert owners([a for a, _ in spans], [b for _, b in spans]) == want


@pytest.fixture
def tree(tmp_path):
    files = {"lib/shapes.py": SHAPES, "app.py": "from lib.shapes import Circle\n\n\ndef run():\n    return helper()\n\n\ndef helper():\n    return 1\n", "gen/out.py": "x = 1\n", "gen/keep.py": "y = 2\n", ".hidden/a.py": "z = 1\n", "note.txt": "no", "main.go": "package main\n", ".gitignore": "# made\n/gen/*\n!keep.py\n"}
    top = tmp_path / "top"
    for path, text in files.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_text(text)
    return top


def test_walk(tree):
    (tree / "big.py").write_bytes(b"#" * (2 * 1024 * 1024 + 1))
    assert [p for p, *_ in walk(str(tree))] == ["app.py", "gen/keep.py", "lib/shapes.py", "main.go"]
    assert [p for p, *_ in walk(str(tree), {"go"})] == ["main.go"]


def touch(path, text):
    path.write_text(text)
    os.utime(path, ns=(10**18, 10**18))  # long ago, so that only a change of size tells


def test_store_follows_the_tree(spark, tree):
    store = Store(spark, str(tree))
    with pytest.raises(QueryError) as e:
        store.load()
    assert e.value.status == Status.NO_INDEX
    assert store.index() == {"files": 4, "extracted": 4, "forgotten": 0}
    assert store.index() == {"files": 4, "extracted": 0, "forgotten": 0}
    names = lambda: {r[0] for r in store.load().query("?- def(_, F, _, N).").rows}
    of = lambda f: {r[0] for r in store.load().query(f'?- def(_, "{f}", _, N).').rows}
    assert of("app.py") == {"run", "helper"} and "lib/shapes.py" in names()
    (tree / "lib/shapes.py").unlink()
    touch(tree / "app.py", "def walk_on(): pass\n")
    assert store.status()["changed"] == 1 and store.status()["gone"] == 1
    assert store.index() == {"files": 3, "extracted": 1, "forgotten": 1}
    assert of("app.py") == {"walk_on"} and names() == {"app.py", "gen/keep.py"}
    touch(tree / "app.py", "def broken(:\n")
    store.index()
    status = store.status()
    assert status["fresh"] and status["syntax_errors"] == [{"file": "app.py", "line": 1}] and status["files"] == {"python": 2, "go": 1}
    with open(os.path.join(store.at, "lock"), "w") as f:
        f.write(str(os.getpid()))
    with pytest.raises(QueryError) as e:
        store.index()
    assert e.value.status == Status.LOCKED
    with open(os.path.join(store.at, "lock"), "w") as f:
        f.write("999999999")  # nobody's
    assert store.index(rebuild=True)["extracted"] == 3
    with open(os.path.join(store.at, "manifest.json"), "w") as f:
        f.write("{")
    with pytest.raises(QueryError) as e:
        store.load()
    assert e.value.status == Status.CORRUPT


def test_discovery(spark, tree):
    (tree / ".git").mkdir()
    with pytest.raises(QueryError):
        discover(str(tree / "lib"))
    Store(spark, str(tree)).index()
    assert discover(str(tree / "lib")) == str(tree) and discover(str(tree.parent)) == str(tree)


def test_command_line(spark, tree, capsys):
    def run(*args):
        out = io.StringIO()
        return main([*args], spark, out), out.getvalue()

    root = ("--root", str(tree))
    assert run("query", "?- file(F, L).", *root)[0] == 1  # no index yet
    assert run("query", "?- file(F, L).", "--expect-empty", *root)[0] == 2
    assert run("index", str(tree))[0] == 0
    assert run("query", '?- calls(A, B).', *root) == (0, "area lib/shapes.py:19\tsquare lib/shapes.py:20\nrun app.py:4\thelper app.py:8\n")
    assert run("query", '?- calls(A, B).', "--raw", *root)[1] == "local app.py run().\tlocal app.py helper().\nlocal lib/shapes.py Circle#area().\tlocal lib/shapes.py Circle#area().square().\n"
    assert run("query", '?- import("app.py", M, _).', "--expect-empty", *root)[0] == 1
    assert run("query", '?- import("main.go", M, _).', "--expect-empty", *root)[0] == 0
    assert run("query", "?- nope(X).", "--expect-empty", *root)[0] == 2
    touch(tree / "app.py", "def fresh(): pass\n")
    assert "app.py" not in run("query", '?- def(S, F, _, "fresh").', "--no-refresh", "--raw", *root)[1]
    code, text = run("query", '?- def(S, F, _, "fresh").', "--format", "json", "--raw", *root)
    answer = json.loads(text)
    assert code == 0 and answer["rows"] == [["local app.py fresh().", "app.py"]] and answer["stats"]["refreshed"] == 1
    (tree / "more.dl").write_text("named(N) :- file(N, _). mine(F) :- file(F, _).")
    assert json.loads(run("query", "?- mine(F).", "--rules", str(tree / "more.dl"), "--format", "json", *root)[1])["stats"]["widened"] == ["named"]
    (tree / "some.facts").write_text('file("a.py", "python"). def("s", "a.py", "class", "A").')
    assert run("query", "?- trait_sym(S).", "--facts", str(tree / "some.facts"), "--raw")[1] == "s\n"
    assert json.loads(run("status", *root)[1])["fresh"] and len(run("schema", *root)[1]) <= 6001
    assert len(schema_text({"relations": {f"r{i}": ["a"] for i in range(2000)}, "rules": {}, "vocabulary": {}})) <= 6000


def test_serve(spark, tree):
    Store(spark, str(tree)).index()
    service, out = Service(spark, str(tree)), io.StringIO()
    ask = lambda i, method, **params: json.dumps({"jsonrpc": "2.0", "id": i, "method": method, "params": params})
    lines = [ask(1, "initialize"), '{"method": "notifications/initialized"}', "{", "[]", ask(2, "tools/list"), ask(3, "tools/call", name="code_query", arguments={"query": '?- named("run").'}), ask(4, "tools/call", name="code_query", arguments={"query": "?- x"}), ask(5, "tools/call", name="other"), ask(6, "gone"), ""]
    serve(service, lines, out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g.get("id") for g in got] == [1, None, None, 2, 3, 4, 5, 6]
    assert got[3]["result"]["tools"][0]["name"] == "code_query"
    assert json.loads(got[4]["result"]["content"][0]["text"])["status"] == "no-scip" or json.loads(got[4]["result"]["content"][0]["text"])["status"] == "ok"
    assert got[5]["result"]["isError"] and got[6]["error"]["code"] == -32602 and got[7]["error"]["code"] == -32601 and got[1]["error"]["code"] == -32700
    assert "rules" in json.loads(respond(service, json.loads(ask(7, "tools/call", name="code_query", arguments={"schema": True})))["result"]["content"][0]["text"])
