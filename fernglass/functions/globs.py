"""Path globs as regular expressions: ``*`` and ``?`` within a component, ``[..]``, ``[!..]``, and ``**`` as a whole component."""

from __future__ import annotations

import re


def glob_regex(pattern: str) -> str:
    """An anchored Java regular expression; a character class is taken by code points."""
    parts, out = pattern.split("/"), []
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out.append("(?:.*)" if last else "(?:[^/]+/)*")
            continue
        out.append(_component(part) + ("" if last else "/"))
    return "(?s)^" + "".join(out) + "$"


def _component(part: str) -> str:
    out, i = [], 0
    while i < len(part):
        c = part[i]
        if c == "*":
            while part[i : i + 1] == "*":
                i += 1
            out.append("[^/]*")
            continue
        if c == "?":
            out.append("[^/]")
        elif c == "[":
            end = part.find("]", i + 2 if part[i + 1 : i + 2] in ("!", "]") else i + 1)
            if end > 0:
                body = part[i + 1 : end]
                negated = body.startswith("!")
                body = re.sub(r"([\\\[\]^&])", r"\\\1", body[negated:])
                out.append(f"[{'^/' if negated else ''}{body}]")
                i = end
            else:
                out.append(r"\[")
        else:
            out.append(re.sub(r"([\\.^$|()+{}\]])", r"\\\1", c))
        i += 1
    return "".join(out)
