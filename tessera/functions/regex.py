"""Regular expressions in Java's dialect.

The pattern language has no look-around and no back references, so it could be matched in linear time; Java's
engine backtracks all the same, and nested repeats may take long on some texts. What bounds them is the time
limit of the query, which cancels its jobs."""

from __future__ import annotations

import re

from tessera.errors import invalid

_FLAGS = re.compile(r"\(\?([a-zA-Z]*)(?:-([a-zA-Z]+))?([:)])")


def to_java(pattern: str) -> str:
    """The pattern with unanchored, Unicode-aware meaning: `$` only at the very end or, in multi-line mode, before a
    newline too; `.` all but a newline. Inline flags hold to the end of their group."""
    out, i, in_class = [], 0, 0
    lines = [False]  # multi-line mode of each open group
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            following = pattern[i + 1 : i + 2]
            if not following:
                raise invalid("the pattern ends in a backslash")
            if following.isdigit() or following in "kGZ":
                raise invalid("back references are no part of the pattern language")
            out.append({"z": "\\z", "A": "\\A"}.get(following, c + following))
            i += 2
            continue
        if c == "[":
            in_class += 1
        elif c == "]" and in_class:
            in_class -= 1
        elif in_class:
            pass
        elif pattern.startswith(("(?=", "(?!", "(?<=", "(?<!", "(?>"), i):
            raise invalid("look-around is no part of the pattern language")
        elif pattern.startswith("(?P<", i):
            lines.append(lines[-1])
            out.append("(?<")
            i += 4
            continue
        elif (m := _FLAGS.match(pattern, i)) and (m[1] or m[2] or m[3] == ":"):
            on, off = m[1], m[2] or ""
            if set(on + off) - set("imsxu"):
                raise invalid(f"the flags `{m[0]}` are no part of the pattern language")
            multi = True if "m" in on else False if "m" in off else lines[-1]
            if m[3] == ":":
                lines.append(multi)
            else:
                lines[-1] = multi
            keep = lambda f: "".join(x for x in f if x in "isx")
            minus = f"-{keep(off)}" if keep(off) else ""
            if m[3] == ":" or keep(on) or minus:
                out.append(f"(?{keep(on)}{minus}{m[3]}")
            i = m.end()
            continue
        elif c == "(":
            lines.append(lines[-1])
        elif c == ")" and len(lines) > 1:
            lines.pop()
        elif c == "$":
            out.append("(?=\\n|\\z)" if lines[-1] else "\\z")
            i += 1
            continue
        elif c == "^":
            out.append("(?:\\A|(?<=\\n))" if lines[-1] else "\\A")
            i += 1
            continue
        elif c in "*+?}" and pattern[i + 1 : i + 2] == "+":
            raise invalid("possessive repeats are no part of the pattern language")
        out.append(c)
        i += 1
    return "(?dUu)" + "".join(out)


def checked(spark, pattern: str) -> str:
    """to_java(), once the JVM has compiled it."""
    java = to_java(pattern)
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(java)
    except Exception as e:
        raise invalid(f"bad pattern: {getattr(getattr(e, 'java_exception', None), 'getMessage', lambda: e)()}") from None
    return java
