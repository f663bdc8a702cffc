"""Field references: dotted paths with ``[]`` fan-out, or JSON pointers; get, set and remove on plain values."""

from __future__ import annotations

MISSING = object()


def steps(ref: str) -> list[str]:
    """``a.b[].c`` -> a, b, [], c; ``/a/b~1c`` -> a, b/c."""
    if ref.startswith("/"):
        return [p.replace("~1", "/").replace("~0", "~") for p in ref[1:].split("/")]
    out: list[str] = []
    for part in ref.split("."):
        name, many = (part[:-2], True) if part.endswith("[]") else (part, False)
        if not name and not many:
            raise ValueError(f"bad field reference {ref!r}")
        out += [name] * bool(name) + ["[]"] * many
    return out


def get(value, ref: str):
    """The value, a list of values under ``[]``, or MISSING."""
    return _get(value, steps(ref))


def _get(value, path: list[str]):
    if not path:
        return value
    head, rest = path[0], path[1:]
    if head == "[]":
        if not isinstance(value, list):
            return MISSING
        return [x for x in (_get(v, rest) for v in value) if x is not MISSING]
    if isinstance(value, dict) and head in value:
        return _get(value[head], rest)
    if isinstance(value, list) and head.isdigit() and int(head) < len(value):
        return _get(value[int(head)], rest)
    return MISSING


def put(value: dict, ref: str, new) -> None:
    """Sets in place; objects on the way are made, everything else there is an error."""
    *way, last = steps(ref)
    targets = [value]
    for step in way:
        found = []
        for t in targets:
            if step == "[]":
                if not isinstance(t, list):
                    raise ValueError(f"{ref!r} leads through something that is no list")
                found += t
            elif isinstance(t, list) and step.isdigit() and int(step) < len(t):
                found.append(t[int(step)])
            elif isinstance(t, dict):
                found.append(t.setdefault(step, {}))
            else:
                raise ValueError(f"{ref!r} leads through something that is no object")
        targets = found
    for t in targets:
        if last == "[]" and isinstance(t, list):
            t[:] = [new] * len(t)
        elif isinstance(t, dict) and last != "[]":
            t[last] = new
        elif isinstance(t, list) and last.isdigit() and int(last) < len(t):
            t[int(last)] = new
        else:
            raise ValueError(f"{ref!r} can't be set")


def remove(value, ref: str) -> bool:
    """Removes in place; whether anything was there."""
    *way, last = steps(ref)
    targets, gone = [value], False
    for step in way:
        found = []
        for t in targets:
            got = t if step == "[]" and isinstance(t, list) else _get(t, [step])
            found += got if step == "[]" and isinstance(got, list) else [] if got is MISSING else [got]
        targets = found
    for t in targets:
        if isinstance(t, dict) and last in t:
            del t[last]
            gone = True
        elif isinstance(t, list) and last.isdigit() and int(last) < len(t):
            del t[int(last)]
            gone = True
    return gone
