"""Configuration, type and contract definitions of a collection: small driver-side metadata, read once when it opens."""

from __future__ import annotations

from dataclasses import dataclass, field
from zoneinfo import ZoneInfo

from ..functions.cel_syntax import ExpressionError, parse
from ..operators.contracts import Contract
from ..operators.jsonschema import SchemaError, check_schema
from ..operators.membership import TypeRule
from ..operators.rules import Type, merge_types
from .markdown import load_yaml, split_frontmatter

#: The closed list of field types.
FIELD_TYPES = ("string", "integer", "number", "boolean", "date", "datetime", "time", "enum", "list", "object", "link", "any")


class ConfigError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Config:
    version: str
    name: str | None = None
    types_folder: str = "_types"
    contracts_folder: str = "_contracts"
    extensions: tuple[str, ...] = ("md",)
    exclude: tuple[str, ...] = ()
    include_subfolders: bool = True
    explicit_type_keys: tuple[str, ...] = ("types", "type")
    validation: str = "warn"
    strict: bool | str = False
    id_field: str | None = "id"
    write_nulls: str = "omit"
    write_empty_lists: bool = True
    write_defaults: bool = True
    rename_update_refs: bool = True
    timezone: str | None = None
    warnings: tuple[str, ...] = ()

    @property
    def strict_profile(self) -> bool:
        """Whether the newer profile (0.3 and later) applies."""
        major, minor = (int(x) for x in self.version.split("-")[0].split(".")[:2])
        return (major, minor) >= (0, 3)


SETTINGS = {
    "types_folder": str, "contracts_folder": str, "record_extensions": list, "extensions": list, "exclude": list, "include_subfolders": bool, "explicit_type_keys": list, "default_validation": str, "validation": str,
    "default_strict": (bool, str), "id_field": str, "write_nulls": str, "write_empty_lists": bool, "write_defaults": bool, "rename_update_refs": bool, "cache_folder": str, "migrations_folder": str, "timezone": str,
}


def parse_config(text: str) -> Config:
    raw = load_yaml(text)
    if not isinstance(raw, dict):
        raise ConfigError("invalid_config", "the configuration must be a mapping")
    version = raw.get("spec_version")
    if not isinstance(version, str) or not version.split("-")[0].replace(".", "").isdigit() or version.count(".") < 1:
        raise ConfigError("invalid_config", "spec_version must be a version text")
    settings = raw.get("settings") or {}
    if not isinstance(settings, dict):
        raise ConfigError("invalid_config", "settings takes names and values")
    warnings = [f"unknown settings key: {k}" for k in settings if k not in SETTINGS]
    for k, kind in SETTINGS.items():
        if k in settings and (not isinstance(settings[k], kind) or kind is not bool and isinstance(settings[k], bool) and bool not in (kind if isinstance(kind, tuple) else (kind,))):
            raise ConfigError("invalid_config", f"settings.{k} has a wrong type")
    bare = lambda xs: tuple(dict.fromkeys(str(x).removeprefix(".") for x in xs))
    extensions = bare(settings["record_extensions"]) or ("md",) if "record_extensions" in settings else tuple(dict.fromkeys(("md", *bare(settings.get("extensions", [])))))
    validation = settings.get("validation", settings.get("default_validation", raw.get("validation")))
    newer = tuple(int(x) for x in version.split("-")[0].split(".")[:2]) >= (0, 3)
    validation = validation or ("error" if newer else "warn")
    if validation not in ("off", "warn", "error"):
        raise ConfigError("invalid_config", "validation must be off, warn or error")
    if settings.get("default_strict", False) not in (True, False, "warn"):
        raise ConfigError("invalid_config", "default_strict must be true, false or warn")
    if settings.get("write_nulls", "omit") not in ("omit", "explicit"):
        raise ConfigError("invalid_config", "write_nulls must be omit or explicit")
    folders = [settings.get("types_folder", "_types").strip("/"), settings.get("contracts_folder", "_contracts").strip("/")]
    if any(not f or ".." in f.split("/") for f in folders) or folders[0] == folders[1]:
        raise ConfigError("invalid_config", "types_folder and contracts_folder must be two folders inside the collection")
    zone = settings.get("timezone", raw.get("timezone"))
    if zone is not None:
        try:
            ZoneInfo(zone)
        except Exception as e:
            raise ConfigError("invalid_config", f"unknown time zone {zone!r}") from e
    return Config(
        version, raw.get("name"), folders[0], folders[1], extensions, tuple(map(str, settings.get("exclude", []))), True if newer else settings.get("include_subfolders", True),
        tuple(map(str, settings.get("explicit_type_keys", ["types", "type"]))), validation, settings.get("default_strict", False), settings.get("id_field", raw.get("id_field", None if newer else "id")),
        "explicit" if newer else settings.get("write_nulls", "omit"), settings.get("write_empty_lists", True), settings.get("write_defaults", True), settings.get("rename_update_refs", True), zone, tuple(warnings),
    )


@dataclass(frozen=True)
class Definition:
    """A type as its file declares it."""

    name: str
    rule: TypeRule
    fields: dict = field(default_factory=dict)
    strict: bool | str = False
    schema: dict | None = None
    path_pattern: str | None = None
    links: dict = field(default_factory=dict)
    unique: tuple = ()
    lifecycle: dict = field(default_factory=dict)
    implements: tuple = ()
    parent: str | None = None

    @property
    def instants(self) -> tuple[str, ...]:
        """Fields of the schema that are date-times."""
        props = (self.schema or {}).get("properties", {})
        return tuple(n for n, p in props.items() if isinstance(p, dict) and p.get("format") == "date-time")


def parse_type(text: str, file_name: str) -> Definition:
    parts = split_frontmatter(text)
    raw = load_yaml(parts[0]) if parts else None
    if not isinstance(raw, dict):
        raise ConfigError("invalid_type_definition", f"{file_name}: a type file has a mapping as frontmatter")
    name = str(raw.get("name") or file_name.rsplit("/", 1)[-1].rsplit(".", 1)[0]).lower()
    match, collection = raw.get("match") or {}, raw.get("collection") or {}
    fields = raw.get("fields") or {}
    for f, d in fields.items():
        _check_field(name, f, d)
    expr = (match.get("expr") or {}).get("$expr") if isinstance(match.get("expr"), dict) else None
    if expr is not None:
        try:
            parse(expr)
        except ExpressionError as e:
            raise ConfigError("invalid_type_definition", f"{name}: match.expr: {e}") from e
    globs = match.get("path_glob") or []
    schema = (raw.get("schema") or {}).get("value", raw.get("schema")) if isinstance(raw.get("schema"), dict) else None
    if schema is not None:
        try:
            check_schema(schema)
        except SchemaError as e:
            raise ConfigError("invalid_type_definition", f"{name}: {e}") from e
    links = {**{f: {"target_type": d.get("target"), "validate_exists": d.get("validate_exists", False)} for f, d in fields.items() if d.get("type") == "link" or (d.get("items") or {}).get("type") == "link"}, **(collection.get("links") or {})}
    defaults = {**{f: d["default"] for f, d in fields.items() if "default" in d}, **(collection.get("read_defaults") or {})}
    computed = {f: d["computed"] for f, d in fields.items() if d.get("computed")}
    rule = TypeRule(name, tuple([globs] if isinstance(globs, str) else globs), tuple(match.get("fields_present") or ()), match.get("where"), expr, defaults, computed, tuple(links))
    unique = [*({"field": f, "scope": "all"} for f, d in fields.items() if d.get("unique") and d.get("type") != "list"), *(collection.get("unique") or [])]
    pattern = raw.get("path_pattern") or (collection.get("path") or {}).get("pattern")
    return Definition(name, rule, fields, raw.get("strict", False), schema, pattern, links, tuple(map(_frozen, unique)), raw.get("lifecycle") or {}, tuple(map(_frozen, raw.get("implements") or ())), raw.get("extends"))


def _frozen(d: dict) -> tuple:
    return tuple(sorted(d.items(), key=lambda kv: kv[0]))


def _check_field(type_name: str, name: str, d) -> None:
    if not isinstance(d, dict):
        raise ConfigError("invalid_type_definition", f"{type_name}.{name}: a field definition is a mapping")
    kind = d.get("type", "any")
    if kind not in FIELD_TYPES:
        raise ConfigError("invalid_type_definition", f"{type_name}.{name}: unknown field type {kind!r}")
    if kind == "enum" and not isinstance(d.get("values"), list):
        raise ConfigError("invalid_type_definition", f"{type_name}.{name}: an enum lists its values")
    if isinstance(d.get("items"), dict):
        _check_field(type_name, f"{name}[]", d["items"])
    for inner, spec in (d.get("fields") or {}).items() if kind == "object" else ():
        _check_field(type_name, f"{name}.{inner}", spec)


def inherit(types: dict[str, Definition]) -> dict[str, Definition]:
    """Single inheritance: a type has its parent's fields and what it doesn't declare itself."""
    from dataclasses import replace

    out: dict[str, Definition] = {}

    def visit(name: str, way: tuple[str, ...]) -> Definition:
        if name in way:
            raise ConfigError("circular_inheritance", " -> ".join((*way, name)))
        if name not in types:
            raise ConfigError("missing_parent_type", f"{way[-1]} extends {name!r}, which is no type")
        if name not in out:
            t = types[name]
            if t.parent:
                p = visit(t.parent.lower(), (*way, name))
                fields = {**p.fields, **t.fields}
                rule = replace(t.rule, read_defaults={**p.rule.read_defaults, **t.rule.read_defaults}, computed={**p.rule.computed, **t.rule.computed}, link_fields=tuple(dict.fromkeys((*p.rule.link_fields, *t.rule.link_fields))))
                t = replace(t, fields=fields, rule=rule, strict=t.strict or p.strict, path_pattern=t.path_pattern or p.path_pattern, links={**p.links, **t.links}, unique=tuple(dict.fromkeys((*p.unique, *t.unique))))
            out[name] = t
        return out[name]

    for name in types:
        visit(name, ())
    return out


def parse_contract(text: str) -> Contract | None:
    """A record contract; other kinds give None."""
    parts = split_frontmatter(text)
    raw = load_yaml(parts[0] if parts else text)
    if not isinstance(raw, dict) or raw.get("contract_kind", raw.get("kind", "record")) not in ("record", "data_contract") or "schema" not in raw and "record" not in raw:
        return None
    schema = raw.get("schema") or (raw.get("record") or {}).get("schema") or {}
    return Contract(str(raw.get("id") or raw.get("name")), schema.get("value", schema))


def with_implementations(contract: Contract, types: dict[str, Definition]) -> Contract:
    found = {}
    for t in types.values():
        for i in map(dict, t.implements):
            if i.get("contract") == contract.name:
                found[t.name] = i.get("fields") or {}
    return Contract(contract.name, contract.schema, found)


__all__ = ["Config", "ConfigError", "Definition", "Type", "inherit", "merge_types", "parse_config", "parse_contract", "parse_type", "with_implementations"]
