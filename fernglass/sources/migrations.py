"""Moving a collection forward: field definitions as JSON Schema, manifests of steps over records, and packs of definitions.

All of it works on the few control files of a collection and on record plans;
every change is all-or-nothing through the collection's own writer.
"""

from __future__ import annotations

import hashlib
import json

import yaml

from .config import Definition, parse_type
from .markdown import load_yaml, split_frontmatter

#: What a field type is in JSON Schema.
PLAIN = {
    "any": {}, "string": {"type": "string"}, "integer": {"type": "integer"}, "number": {"type": "number"}, "boolean": {"type": "boolean"}, "link": {"type": "string"},
    "date": {"type": "string", "format": "date"}, "datetime": {"type": "string", "format": "date-time"}, "time": {"type": "string", "format": "time"},
}


def field_schema(d: dict) -> dict:
    """The JSON Schema of one field definition."""
    kind = d.get("type", "any")
    if kind == "enum":
        out = {"enum": list(d.get("values", []))}
    elif kind == "list":
        out = {"type": "array", "items": field_schema(d.get("items") or {})}
    elif kind == "object":
        inner = d.get("fields") or {}
        out = {"type": "object", "properties": {n: field_schema(x) for n, x in inner.items()}, "additionalProperties": not inner}
        if needed := [n for n, x in inner.items() if x.get("required")]:
            out["required"] = needed
    else:
        out = dict(PLAIN.get(kind, {}))
    low, high = {"string": ("minLength", "maxLength"), "list": ("minItems", "maxItems")}.get(kind, ("minimum", "maximum"))
    for key, name in (("min", low), ("max", high), ("min_length", "minLength"), ("max_length", "maxLength"), ("min_items", "minItems"), ("max_items", "maxItems"), ("pattern", "pattern"), ("description", "description")):
        if key in d:
            out[name] = d[key]
    if d.get("unique") and kind == "list":
        out["uniqueItems"] = True
    return out


def link_rules(name: str, d: dict) -> dict:
    """Selector -> rule of every link inside a field."""
    kind = d.get("type")
    if kind == "link":
        return {name: {"target_type": d.get("target", "any"), "validate_exists": d.get("validate_exists") is True}}
    if kind == "list":
        return link_rules(f"{name}[]", d.get("items") or {})
    if kind == "object":
        return {k: v for n, x in (d.get("fields") or {}).items() for k, v in link_rules(f"{name}.{n}", x).items()}
    return {}


def newer_type(t: Definition) -> tuple[dict, list[str]]:
    """(frontmatter of the type in the newer profile, notes on what needs a look)."""
    notes, collection, create, update = [], {}, {}, {}
    required = [n for n, d in t.fields.items() if d.get("required")]
    schema = {"type": "object", "properties": {n: field_schema(d) for n, d in t.fields.items()}, **({"required": required} if required else {})}
    if t.strict is True:
        schema["additionalProperties"] = False
    if links := {k: v for n, d in t.fields.items() for k, v in link_rules(n, d).items()}:
        collection["links"] = links
    if defaults := {n: d["default"] for n, d in t.fields.items() if "default" in d}:
        collection["read_defaults"] = defaults
    if unique := [{"field": n, "scope": "type"} for n, d in t.fields.items() if d.get("unique") and d.get("type") != "list"]:
        collection["unique"] = unique
    if t.path_pattern:
        collection["path"] = {"pattern": t.path_pattern}
    for n, d in t.fields.items():
        how = d.get("generated")
        if how in ("uuid", "ulid"):
            create[n] = {how: True}
        elif how in ("now", "now_on_write"):
            create[n] = {"today" if d.get("type") == "date" else "now": True}
            if how == "now_on_write":
                update[n] = create[n]
        elif isinstance(how, dict) and how.get("transform") == "slugify" and not str(how.get("from", "")).startswith("file."):
            create[n] = {"slugify": how["from"]}
        elif how is not None:
            notes.append(f"{n}: generated value {how!r} has no provider in the newer profile")
        if d.get("computed"):
            notes.append(f"{n}: computed fields become query projections")
    out = {"name": t.name, "kind": "type", "schema": schema}
    rule = t.rule
    match = {k: v for k, v in (("path_glob", list(rule.path_glob)), ("fields_present", list(rule.fields_present)), ("where", rule.where)) if v}
    if match:
        out["match"] = match
    if collection:
        out["collection"] = collection
    if create or update:
        out["lifecycle"] = {k: {"set": v} for k, v in (("on_create", create), ("on_update", update)) if v}
    return out, notes


def document(frontmatter: dict, body: str = "") -> str:
    return "---\n" + yaml.safe_dump(frontmatter, sort_keys=False, allow_unicode=True) + "---\n" + body


def migrate_types(collection, dry_run: bool = True) -> dict[str, dict]:
    """Rewrites every type file and the configuration for the newer profile; gives type -> {frontmatter, notes}."""
    plan = {}
    for t in collection.types.values():
        made, notes = newer_type(t)
        parse_type(document(made), t.name)
        plan[t.name] = {"frontmatter": made, "notes": notes}
    if not dry_run:
        folder, files = collection.config.types_folder, collection.files
        old = {n: files.read(f"{folder}/{n}") for n in files.names(folder) if n.endswith(".md")}
        steps = []
        for name, data in old.items():
            parsed = parse_type(data.decode(), name)
            parts = split_frontmatter(data.decode())
            text = document(plan[parsed.name]["frontmatter"], parts[1] if parts else "")
            steps.append(lambda n=name, x=text: files.write(f"{folder}/{n}", x.encode()))
        config = files.read(collection.config_name)
        raw = load_yaml(config.decode())
        raw["spec_version"] = "0.3.0"
        steps.append(lambda: files.write(collection.config_name, yaml.safe_dump(raw, sort_keys=False).encode()))
        collection._all_or_nothing(steps)
    return plan


def run_manifest(collection, manifest: dict, dry_run: bool = False) -> list[dict]:
    """Steps ``{action: backfill, type, field, value}`` in order; ``add_field`` is done by hand and only told."""
    out = []
    for step in manifest.get("steps", []):
        if step.get("action") == "backfill":
            missing = {"and": [{step["field"]: {"exists": False}}]}
            from pyspark.sql import functions as F

            r = collection.records(defaults=False)
            from ..operators.writes import condition

            rows = r.df.where(F.array_contains("types", step["type"].lower()) & condition(r, missing)).select("path").orderBy("path").collect()
            changed = [x["path"] for x in rows]
            if not dry_run:
                work = []
                for p in changed:
                    fields, body, _ = collection._stored(p)
                    work.append(lambda p=p, f={**fields, step["field"]: step["value"]}, b=body: collection._write(p, f, b))
                collection._all_or_nothing(work)
            out.append({**step, "changed": changed})
        else:
            out.append({**step, "manual": True})
    return out


# --- packs ---


class MergeConflict(ValueError):
    pass


_NOTHING = object()


def merge(base, current, desired, path: str = ""):
    """Three-way merge: a side that left the base alone takes the other's value; two different changes conflict."""
    if current == base or current == desired:
        return desired
    if desired == base:
        return current
    if all(isinstance(x, dict) for x in (base, current, desired)):
        out = {}
        for k in sorted({*base, *current, *desired}):
            got = merge(base.get(k, _NOTHING), current.get(k, _NOTHING), desired.get(k, _NOTHING), f"{path}/{k}")
            if got is not _NOTHING:
                out[k] = got
        return out
    raise MergeConflict(f"both sides changed {path or '/'}")


def digest(text: str) -> str:
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


LOCK = "packs.lock.json"


def assess(collection, pack: dict) -> dict:
    """What installing would do: for each resource create, update, unchanged, preserve or conflict.

    ``pack``: id, version, resources [{target, document, mode: managed | seed, baselines?: [document]}].
    """
    files = collection.files
    lock = json.loads(files.read(LOCK)) if files.exists(LOCK) else {"packs": {}}
    owned = lock["packs"].get(pack["id"], {}).get("resources", {})
    resources = []
    for r in pack["resources"]:
        target, text = collection._checked(r["target"]), r["document"]
        live = files.read(target).decode() if files.exists(target) else None
        new, reason = text, None
        if live is None:
            action = "create"
        elif live == text:
            action = "unchanged"
        elif r.get("mode") == "seed":
            base = next((b for b in r.get("baselines", []) if digest(b) == owned.get(target)), None)
            if live in r.get("baselines", []):
                action = "update"
            elif base is None:
                action = "preserve"
            else:
                try:
                    parts = [split_frontmatter(x) for x in (base, live, text)]
                    new, action = document(merge(*[load_yaml(p[0]) for p in parts]), parts[1][1]), "update"
                except MergeConflict as e:
                    action, reason = "conflict", str(e)
        else:
            action = "update" if owned.get(target) == digest(live) else "conflict"
        resources.append({"target": target, "action": action, "document": new, "origin": digest(text), **({"reason": reason} if reason else {})})
    actions = {r["action"] for r in resources}
    status = "conflict" if "conflict" in actions else "current" if actions <= {"unchanged", "preserve"} else "install"
    return {"status": status, "resources": resources, "digest": digest(json.dumps([(r["target"], r["action"], r["origin"]) for r in resources]))}


def install(collection, pack: dict, expected: str | None = None) -> dict:
    """Applies a pack whole or not at all, and notes what it owns in the lock file."""
    plan = assess(collection, pack)
    if plan["status"] == "conflict" or expected is not None and expected != plan["digest"]:
        raise MergeConflict("the pack conflicts with the collection, or the collection has changed since it was assessed")
    files = collection.files
    lock = json.loads(files.read(LOCK)) if files.exists(LOCK) else {"packs": {}}
    before = lock["packs"].get(pack["id"], {}).get("resources", {})
    steps = []
    for r in plan["resources"]:
        if r["action"] in ("create", "update"):
            if r["target"].startswith(collection.config.types_folder + "/"):
                parse_type(r["document"], r["target"])
            steps.append(lambda r=r: files.write(r["target"], r["document"].encode()))
    lock["packs"][pack["id"]] = {"version": pack["version"], "resources": {r["target"]: r["origin"] if r["action"] != "preserve" else before.get(r["target"]) for r in plan["resources"]}}
    steps.append(lambda: files.write(LOCK, json.dumps(lock, indent=1).encode()))
    collection._all_or_nothing(steps)
    return plan
