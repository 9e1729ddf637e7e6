"""How declarations are named: `local <path> <descriptors>`."""

from __future__ import annotations

SUFFIX = dict.fromkeys(("type", "interface", "struct", "enum", "trait", "class", "union"), "#") | dict.fromkeys(("function", "method", "constructor", "macro"), "().") | dict.fromkeys(("field", "constant", "variable", "property"), ".") | {"module": "/"}
TYPE_LIKE = frozenset(k for k, s in SUFFIX.items() if s == "#")


def escape(name: str) -> str:
    """The name, between backticks if it holds more than letters, digits and `_ $ - +`."""
    if name and all(c.isalnum() or c in "_$-+" for c in name):
        return name
    return "`" + name.replace("`", "``") + "`"


def descriptor(kind: str, name: str) -> str:
    return escape(name) + SUFFIX[kind]
