"""Facts of one Python file, read from its syntax tree: declarations, their owners, names, documentation, calls and imports."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from dataclasses import dataclass

from tessera.operators.sweep import owners
from tessera.sources.symbols import TYPE_LIKE, descriptor

SIG_CAP = 512
#: A fact: its relation, its strings and its integers, each in the order of the relation's columns.
Fact = tuple[str, list[str], list[int]]


@dataclass
class Item:
    kind: str
    name: str
    start: int  # of the declaration itself, in bytes
    end: int
    first: int  # with its decorators
    lines: tuple[int, int]
    name_at: tuple[int, int]
    sig: str
    doc: str


class Source:
    """Text with byte offsets: lines count from 1, columns are bytes of UTF-8."""

    def __init__(self, text: str):
        self.bytes = text.encode()
        self.starts = [0]
        for m in re.finditer(rb"\r\n|\r|\n|\x0c", self.bytes):
            if m[0] != b"\x0c":
                self.starts.append(m.end())

    def at(self, line: int, col: int) -> int:
        return self.starts[line - 1] + col

    def place(self, offset: int) -> tuple[int, int]:
        low, high = 0, len(self.starts)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.starts[mid] <= offset else (low, mid)
        return low + 1, offset - self.starts[low]

    def text(self, start: int, end: int) -> str:
        return self.bytes[start:end].decode(errors="replace")


def collapse(text: str, most: int) -> str:
    """White space as single blanks, cut to so many bytes of whole characters."""
    return " ".join(text.split()).encode()[:most].decode(errors="ignore")


def docstring(src: Source, body: list[ast.stmt]) -> str:
    """The content of a leading string as written, each line without its indentation."""
    if not body or not isinstance(body[0], ast.Expr) or not isinstance(body[0].value, ast.Constant) or not isinstance(body[0].value.value, str):
        return ""
    v = body[0].value
    m = re.fullmatch(r"""[a-zA-Z]*(\"\"\"|'''|"|')(.*)\1""", src.text(src.at(v.lineno, v.col_offset), src.at(v.end_lineno, v.end_col_offset)), re.S)
    return "\n".join(x.strip() for x in m[2].splitlines()).strip() if m else ""


def header(src: Source, start: int, end: int) -> str:
    """From the keyword to the colon that opens the body, comments left out at its end."""
    text, depth, last = src.text(start, end), 0, None
    lines = text.splitlines(keepends=True)
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.OP and t.string in "([{":
                depth += 1
            elif t.type == tokenize.OP and t.string in ")]}":
                depth -= 1
            elif t.type == tokenize.OP and t.string == ":" and not depth:
                break
            if t.type not in (tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT):
                last = t.end
    except (tokenize.TokenError, IndentationError):
        pass
    if last is None:
        return ""
    return collapse("".join(lines[: last[0] - 1]) + lines[last[0] - 1][: last[1]], SIG_CAP)


def declarations(src: Source, tree: ast.Module) -> list[Item]:
    out: list[Item] = []

    def named(node: ast.AST, kind: str) -> Item:
        start, end = src.at(node.lineno, node.col_offset), src.at(node.end_lineno, node.end_col_offset)
        m = re.compile(rb"(?:async(?:\s|\\\r?\n)+)?(?:def|class)(?:\s|\\\r?\n)+").match(src.bytes, start)
        first = start
        for d in reversed(node.decorator_list):  # those that touch what comes after them
            gap = src.bytes[src.at(d.end_lineno, d.end_col_offset) : first]
            if gap.strip() or gap.count(b"\n") > 1:
                break
            first = src.bytes.rindex(b"@", 0, src.at(d.lineno, d.col_offset))
        return Item(kind, node.name, start, end, first, (src.place(first)[0], node.end_lineno), src.place(m.end() if m else start), header(src, start, end), docstring(src, node.body))

    def bound(node: ast.stmt, kind: str) -> None:
        target = node.targets[0] if isinstance(node, ast.Assign) else node.target if isinstance(node, ast.AnnAssign) else None
        if isinstance(target, ast.Name) and (not isinstance(node, ast.AnnAssign) or node.simple):
            start, end = src.at(node.lineno, node.col_offset), src.at(node.end_lineno, node.end_col_offset)
            out.append(Item(kind, target.id, start, end, start, (node.lineno, node.end_lineno), (target.lineno, target.col_offset), target.id, ""))

    for statement in tree.body:
        bound(statement, "variable")
    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef):
            out.append(named(node, "class"))
            for statement in node.body:
                bound(statement, "field")
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(named(node, "function"))
    return sorted(out, key=lambda i: (i.start, -i.end))


def calls(src: Source, tree: ast.Module) -> list[tuple[str, int]]:
    """Name and byte of what is called: a bare name, or the last part of a dotted one."""
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            out.append((node.func.id, src.at(node.func.lineno, node.func.col_offset)))
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
            out.append((node.func.attr, src.at(node.func.end_lineno, node.func.end_col_offset) - len(node.func.attr.encode())))
    return sorted(out, key=lambda c: c[1])


def facts(path: str, text: str) -> tuple[list[Fact], int | None]:
    """The facts of a file, and the line of its first syntax error (then nothing but the file is known)."""
    out: list[Fact] = [("file", [path, "python"], [])]
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return out, getattr(e, "lineno", None) or 1
    src = Source(text)
    items, refs = declarations(src, tree), calls(src, tree)
    spans = [(i.start, i.end) for i in items] + [(at, at) for _, at in refs]
    owner = owners([a for a, _ in spans], [b for _, b in spans])
    for i, item in enumerate(items):
        if item.kind == "function" and owner[i] is not None and items[owner[i]].kind in TYPE_LIKE:
            item.kind = "method"
    symbols: list[str] = []
    for i, item in enumerate(items):  # owners start before what they own
        own = descriptor(item.kind, item.name)
        symbols.append(symbols[owner[i]] + own if owner[i] is not None else f"local {path} {own}")
    for i, item in enumerate(items):
        s, parent = symbols[i], path if owner[i] is None else symbols[owner[i]]
        public = not item.name.startswith("_") or item.name.startswith("__") and item.name.endswith("__")
        out += [
            ("def", [s, path, item.kind, item.name], []),
            ("def_span", [s], [*item.lines, item.first, item.end]),
            ("def_name", [s], list(item.name_at)),
            ("parent", [s, parent], []),
            ("visibility", [s, "public" if public else "restricted"], []),
        ]
        out += [("def_sig", [s, item.sig], [])] * bool(item.sig) + [("def_doc", [s, item.doc], [])] * bool(item.doc)
    for k, (name, at) in enumerate(refs):
        o = owner[len(items) + k]
        while o is not None and o >= len(items):  # a call at the place of another one owns nothing
            o = owner[o]
        out.append(("name_ref", [name, path, path if o is None else symbols[o]], list(src.place(at))))
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [("import", [path, a.name, a.asname or ""], []) for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module != "__future__":
            out.append(("import", [path, "." * node.level + (node.module or ""), ""], []))
    return out, None
