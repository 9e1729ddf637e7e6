"""Fact files: one ground fact a statement."""

from __future__ import annotations

from tessera.errors import invalid
from tessera.plans.syntax import Const, parse


def read_facts(text: str) -> dict[str, list[tuple]]:
    program = parse(text)
    if program.query is not None:
        raise invalid("a fact file holds no query")
    out: dict[str, list[tuple]] = {}
    for r in program.rules:
        if r.body:
            raise invalid(f"`{r.head.name}` has a body; a fact file holds facts only", r.head.at)
        if not all(isinstance(t, Const) for t in r.head.args):
            raise invalid(f"`{r.head.name}` has an argument that isn't a constant", r.head.at)
        rows = out.setdefault(r.head.name, [])
        if rows and len(rows[0]) != len(r.head.args):
            raise invalid(f"`{r.head.name}` has {len(rows[0])} arguments before, {len(r.head.args)} here", r.head.at)
        rows.append(tuple(t.value for t in r.head.args))
    return out
