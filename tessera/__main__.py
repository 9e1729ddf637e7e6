"""The command line: index, query, schema, status and serve."""

from __future__ import annotations

import argparse
import json
import sys
import time

from tessera.engine import Answer, Engine, Limits
from tessera.errors import QueryError, Status

#: An answer waits so long for changed files to be read again; with more of them it says that it is stale.
REFRESH_MS, REFRESH_FILES = 2000, 200


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tessera").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


class Service:
    """The store of a tree with its engine, which stays warm while the manifest does."""

    def __init__(self, spark, root: str, index_dir: str | None = None, rules: list[str] | None = None, refresh: bool = True):
        from tessera.store import Store

        self.store, self.rules, self.refresh = Store(spark, root, index_dir), rules or [], refresh
        self.engine, self.state, self.widened = None, None, []

    def current(self) -> tuple[Engine, int]:
        """The engine, and how many files were read again before."""
        m, again = self.store.manifest(), 0
        stale = False
        if self.refresh:
            _, changed, gone = self.store.changes(m, set(m["languages"]) or None)
            if len(changed) > REFRESH_FILES:
                stale = True
            elif changed or gone:
                try:
                    again = self.store.index()["extracted"]
                    m = self.store.manifest()
                except QueryError as e:
                    if e.status != Status.LOCKED:
                        raise
                    stale = True
        if self.engine is None or self.state != m["gen"]:
            self.engine, self.state, self.widened = self.store.load(m=m), m["gen"], []
            for text in self.rules:
                self.widened += self.engine.load_rules(text)
        self.engine.stale = stale
        return self.engine, again

    def query(self, text: str, limit: int | None = None, raw: bool = False) -> Answer:
        try:
            start = time.monotonic()
            e, again = self.current()
            a = e.query(text, limit, raw)
            a.stats |= {"refreshed": again, "widened": sorted(set(self.widened)), "milliseconds": round(1000 * (time.monotonic() - start))}
            return a
        except QueryError as x:
            return Answer(x.status, hint=str(x), root=self.store.root)


TOOL = {
    "name": "code_query",
    "description": "Answers a Datalog query over the facts of the indexed source tree; with schema, says which relations and rules there are.",
    "inputSchema": {"type": "object", "properties": {"query": {"type": "string"}, "schema": {"type": "boolean"}, "limit": {"type": "integer", "minimum": 0}, "raw": {"type": "boolean"}}},
}


def respond(service: Service, message: dict) -> dict | None:
    """The response to one JSON-RPC message; none to a notification."""
    ident, method, params = message.get("id"), message.get("method"), message.get("params") or {}
    done = lambda result: {"jsonrpc": "2.0", "id": ident, "result": result}
    failed = lambda code, text: {"jsonrpc": "2.0", "id": ident, "error": {"code": code, "message": text}}
    if "id" not in message:
        return None
    if method == "initialize":
        return done({"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "tessera", "version": "0"}})
    if method == "ping":
        return done({})
    if method == "tools/list":
        return done({"tools": [TOOL]})
    if method != "tools/call":
        return failed(-32601, f"no method `{method}`")
    args = params.get("arguments") or {}
    if params.get("name") != TOOL["name"] or not isinstance(args, dict) or set(args) - set(TOOL["inputSchema"]["properties"]):
        return failed(-32602, "one tool, code_query, with query, schema, limit, raw")
    if args.get("schema"):
        body, bad = json.dumps(service.current()[0].catalog()), False
    elif isinstance(args.get("query"), str):
        a = service.query(args["query"], args.get("limit", 200), bool(args.get("raw")))
        body, bad = json.dumps(a.to_dict()), not a.status.answered
    else:
        return failed(-32602, "query or schema is missing")
    return done({"content": [{"type": "text", "text": body}], "isError": bad})


def serve(service: Service, lines=sys.stdin, out=sys.stdout) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            if not isinstance(message, dict):
                raise ValueError("a message is an object")
        except ValueError as e:
            answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        else:
            try:
                answer = respond(service, message)
            except QueryError as e:
                answer = {"jsonrpc": "2.0", "id": message.get("id"), "error": {"code": -32000, "message": f"{e.status.value}: {e}"}}
        if answer is not None:
            print(json.dumps(answer), file=out, flush=True)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index", help="read a source tree into its store")
    i.add_argument("path", nargs="?", default=".")
    i.add_argument("--rebuild", action="store_true")
    i.add_argument("--lang", action="append", default=[])
    q = sub.add_parser("query", help="answer a query")
    q.add_argument("text")
    q.add_argument("--format", choices=("text", "json"), default="text")
    q.add_argument("--limit", type=int)
    q.add_argument("--no-refresh", action="store_true")
    q.add_argument("--raw", action="store_true")
    q.add_argument("--rules", action="append", default=[])
    q.add_argument("--facts", help="a file of ground facts instead of a store")
    q.add_argument("--expect-empty", action="store_true")
    s = sub.add_parser("schema", help="relations, rules and vocabularies")
    s.add_argument("--format", choices=("text", "json"), default="text")
    sub.add_parser("status", help="what the store holds and whether it is fresh")
    sub.add_parser("serve", help="answer JSON-RPC messages, one a line")
    for x in sub.choices.values():
        x.add_argument("--index-dir")
        if x is not i:
            x.add_argument("--root")
    return p


def schema_text(catalog: dict, most: int = 6000) -> str:
    lines = ["relations:", *(f"  {n}({', '.join(c)})" for n, c in catalog["relations"].items()), "rules:", *(f"  {s}  {d}".rstrip() for s, d in catalog["rules"].values())]
    for what, counts in catalog["vocabulary"].items():
        lines.append(f"{what}: " + ", ".join(f"{k} {n}" for k, n in counts.items()))
    text = "\n".join(lines)
    return text if len(text) <= most else text[: most - 4].rpartition("\n")[0] + "\n..."


def main(argv: list[str] | None = None, spark=None, out=None) -> int:
    from tessera.store import Store, discover

    args, out = parser().parse_args(argv), out or sys.stdout
    say = lambda text: print(text, file=out)
    expects = getattr(args, "expect_empty", False)
    try:
        spark = spark or session()
        if args.command == "index":
            say(json.dumps(Store(spark, args.path, args.index_dir).index(args.rebuild, set(args.lang) or None)))
            return 0
        rules = []
        for path in getattr(args, "rules", []):
            with open(path) as f:
                rules.append(f.read())
        if args.command == "query" and args.facts:
            e = Engine(spark, Limits(), code=True)
            with open(args.facts) as f:
                e.load_facts(f.read())
            for text in rules:
                e.load_rules(text)
            answer = e.query(args.text, args.limit, args.raw)
        else:
            service = Service(spark, args.root or discover("."), args.index_dir, rules, not getattr(args, "no_refresh", False))
            if args.command == "serve":
                serve(service, out=out)
                return 0
            if args.command == "status":
                say(json.dumps(service.store.status(), indent=1))
                return 0
            if args.command == "schema":
                c = service.current()[0].catalog()
                say(json.dumps(c) if args.format == "json" else schema_text(c))
                return 0
            answer = service.query(args.text, args.limit, args.raw)
    except (QueryError, OSError) as e:
        print(f"{e.status.value if isinstance(e, QueryError) else 'error'}: {e}", file=sys.stderr)
        return 2 if expects else 1
    if args.format == "json":
        say(json.dumps(answer.to_dict()))
    else:
        out.write(answer.to_text())
        if answer.hint or answer.status != Status.OK:
            print(f"{answer.status.value}: {answer.hint}".rstrip(": "), file=sys.stderr)
    return answer.exit_code(expects)


if __name__ == "__main__":
    sys.exit(main())
