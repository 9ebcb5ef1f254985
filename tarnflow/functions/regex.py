"""Python regular expressions as Java ones, for patterns and replacements that users write."""

from __future__ import annotations

import re

_GROUP_NAME = re.compile(r"\(\?P<(\w+)>")
_BACK_NAME = re.compile(r"\(\?P=(\w+)\)")


def java_pattern(pattern: str) -> str:
    """``pattern`` for Java, with Unicode classes as Python has them; ValueError if it is no pattern."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"invalid regular expression {pattern!r}: {e}") from e
    out = _BACK_NAME.sub(r"\\k<\1>", _GROUP_NAME.sub(r"(?<\1>", pattern)).replace(r"\Z", r"\z")
    return f"(?U){out}"


def java_replacement(replacement: str) -> str:
    r"""``\1`` and ``\g<name>`` as ``$1`` and ``${name}``; a literal dollar is escaped."""
    out, i = [], 0
    while i < len(replacement):
        c = replacement[i]
        if c == "\\" and i + 1 < len(replacement):
            n = replacement[i + 1]
            if m := re.match(r"\\g<(\w+)>", replacement[i:]):
                out.append(f"${m[1]}" if m[1].isdigit() else "${" + m[1] + "}")
                i += m.end()
                continue
            if n.isdigit():
                m = re.match(r"\\(\d{1,2})", replacement[i:])
                out.append(f"${m[1]}")
                i += m.end()
                continue
            out.append({"n": "\n", "t": "\t", "r": "\r"}.get(n, "\\" + n))
            i += 2
            continue
        out.append("\\$" if c == "$" else c)
        i += 1
    return "".join(out)
