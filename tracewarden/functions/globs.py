"""Glob patterns as regular expressions that Catalyst can evaluate with ``rlike``."""

from __future__ import annotations

import re


def glob_to_regex(pattern: str) -> str:
    """Translate a glob to an anchored Java/RE2-safe regex.

    ``*`` and ``?`` also match ``/``. A whole path component ``**`` matches any number of
    components, including none. ``[..]``, ``[!..]`` and ``{a,b}`` are supported.
    """
    out, i, depth = [], 0, 0
    while i < len(pattern):
        rest, c = pattern[i:], pattern[i]
        at_component = i == 0 or pattern[i - 1] == "/"
        if at_component and rest.startswith("**/"):
            out.append("(?:.*/)?")
            i += 3
        elif at_component and rest == "**":
            out.append(".*")
            i += 2
        elif c == "*":
            out.append(".*")
            i += 1
        elif c == "?":
            out.append(".")
            i += 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            negate = body[:1] in ("!", "^")
            members = re.sub(r"([\\\[\]^&])", r"\\\1", body[1:] if negate else body)
            out.append(f"[{'^' if negate else ''}{members}]")
            i = end + 1
        elif c == "{":
            out.append("(?:")
            depth += 1
            i += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
            i += 1
        elif c == "," and depth:
            out.append("|")
            i += 1
        elif c == "\\" and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 2
        else:
            out.append(re.escape(c))
            i += 1
    return "(?s)^(?:" + "".join(out) + ")$"


def any_glob(patterns: list[str]) -> str:
    """One alternation for a pattern list, so a row is tested by a single compiled regex."""
    return "|".join(f"(?:{glob_to_regex(p)})" for p in patterns)
