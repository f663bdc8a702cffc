"""A directory of Markdown records as one object: open it, read and query it, check it, change it.

Whole-collection operations are DataFrame plans; operations on a single record
read and write that one file through the store's own file system.
"""

from __future__ import annotations

import json
import re
import secrets
import uuid
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import field_refs
from .functions.cel import Scope, compile_expression
from .functions.legacy import Scope as LegacyScope
from .functions.legacy import compile_expression as compile_legacy
from .functions.values import as_kind
from .journal import FOLDER as JOURNALS
from .journal import Journal, undo
from .observability import traced
from .operators import links as L
from .operators import writes as W
from .operators.coercion import coerced
from .operators.contracts import Contract, contract_issues, contract_view
from .operators.jsonschema import schema_issues
from .operators.membership import with_defaults, with_types
from .operators.rules import ISSUES, Type, filename_issues, link_issues, unique_issues, validate
from .plans.legacy_query import LegacyResult, Names, execute_legacy
from .plans.query import Planner, Result, execute
from .plans.views import Views
from .records import Records
from .sources.config import Config, Definition, inherit, parse_config, parse_contract, parse_type, with_implementations
from .sources.markdown import Scan, load_yaml, parse_record, read_markdown, render_record


class CollectionError(ValueError):
    def __init__(self, code: str, message: str, details: object = None):
        super().__init__(message)
        self.code, self.details = code, details


class Files:
    """The store's file system, seen from a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._jvm = root.rstrip("/"), spark._jvm
        self._fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), spark._jsc.hadoopConfiguration())
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        self._over = spark.sparkContext._gateway.new_array(rename, 1)
        self._over[0] = rename.OVERWRITE
        self.journal: Journal | None = None

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self.path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        if self.journal is not None:
            self.journal.before(name)
        self.put(name, data)

    def put(self, name: str, data: bytes) -> None:
        """A hidden sibling first, then one rename over the target: a reader finds the old file or the new one."""
        folder, _, base = name.rpartition("/")
        temp = f"{folder}/.{base}.{uuid.uuid4().hex}.tmp".lstrip("/")
        stream = self._fs.create(self.path(temp), True)
        stream.write(bytearray(data))
        stream.close()
        try:
            self._context.rename(self._qualified(temp), self._qualified(name), self._over)
        except Exception as e:
            self._fs.delete(self.path(temp), False)
            raise CollectionError("write_failed", f"{name} could not be written") from e

    def _qualified(self, name: str):
        return self._context.makeQualified(self.path(name))

    def delete(self, name: str) -> None:
        if self.journal is not None:
            self.journal.before(name)
        self.drop(name)

    def drop(self, name: str) -> None:
        """A file, or a folder with all in it."""
        self._fs.delete(self.path(name), True)

    def folders(self, name: str) -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.path(name)) if s.isDirectory())

    def names(self, folder: str = "") -> list[str]:
        """Plain files right in a folder."""
        if folder and not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.path(folder)) if s.isFile())


class Collection:
    def __init__(self, spark: SparkSession, root: str, config: Config, config_name: str, types: dict[str, Definition], contracts: dict[str, Contract]):
        self.spark, self.root, self.config, self.config_name, self.types, self.contracts = spark, root, config, config_name, types, contracts
        self.files = Files(spark, root)
        self._kept: dict[tuple, Records] = {}

    def refresh(self) -> None:
        """Forgets what has been parsed; every write does so."""
        for r in self._kept.values():
            r.df.unpersist()
        self._kept.clear()

    @classmethod
    def open(cls, spark: SparkSession, root: str, config_name: str | None = None) -> "Collection":
        """``config_name``: the configuration file's name; without it the YAML file in the root that has a spec_version."""
        files = Files(spark, root)
        if config_name is None:
            for name in files.names():
                if name.endswith((".yaml", ".yml")) and isinstance(got := load_yaml(files.read(name).decode()), dict) and "spec_version" in got:
                    config_name = name
                    break
            else:
                raise CollectionError("missing_config", f"{root} holds no configuration")
        elif not files.exists(config_name):
            raise CollectionError("missing_config", f"{root} holds no {config_name}")
        config = parse_config(files.read(config_name).decode())
        types = [parse_type(files.read(f"{config.types_folder}/{n}").decode(), n) for n in files.names(config.types_folder) if n.endswith(".md")]
        by_name = inherit({t.name: t for t in types})
        contracts = [parse_contract(files.read(f"{config.contracts_folder}/{n}").decode()) for n in files.names(config.contracts_folder)]
        for name in files.folders(JOURNALS):  # a batch that wasn't finished
            undo(files, f"{JOURNALS}/{name}")
        return cls(spark, root, config, config_name, by_name, {c.name: with_implementations(c, by_name) for c in contracts if c})

    # --- reading ---

    @property
    def scan_options(self) -> Scan:
        c = self.config
        return Scan(c.extensions, c.exclude, c.include_subfolders, c.types_folder, (self.config_name,), c.validation)

    def records(self, types: bool = True, defaults: bool = True) -> Records:
        """All records with their types, defaults and computed fields; parsed once until something is written."""
        key = (types, defaults)
        if key not in self._kept:
            r = self._records(types, defaults)
            self._kept[key] = r.with_df(r.df.persist())
        return self._kept[key]

    def _records(self, types: bool, defaults: bool) -> Records:
        links = tuple(dict.fromkeys(f.split(".")[0].removesuffix("[]").lstrip("/") for t in self.types.values() for f in t.links))
        instants = [set(t.instants) for t in self.types.values()]
        common = tuple(sorted(set.intersection(*instants))) if instants else ()
        r = read_markdown(self.spark, self.root, self.scan_options, link_fields=links, id_field=self.config.id_field, instants=common)
        if not types:
            return r
        if defaults:
            r = self.records(defaults=False)
            for t in self.types.values():
                r = self._completed(r, t)
            return r
        return with_types(self.records(types=False), [t.rule for t in self.types.values()], self.config.explicit_type_keys)

    def _completed(self, r: Records, t: Definition) -> Records:
        """Defaults, declared types and computed fields of one type, in its own records."""
        own = F.array_contains("types", t.name)
        if t.rule.read_defaults:
            filled = with_defaults(r.with_df(r.df.withColumn("__old", F.col("fields"))), t.rule.read_defaults).df
            r = r.with_df(filled.withColumn("fields", F.when(own, F.col("fields")).otherwise(F.col("__old"))).drop("__old"))
        r = coerced(r, t.fields, own)
        if t.rule.computed:
            p = Planner(r, datetime.now(timezone.utc), "UTC")
            p.df = r.df
            values, missing = {}, {}
            for name, expr in t.rule.computed.items():
                if self.config.strict_profile:
                    v = compile_expression(expr, p.scope())
                else:
                    v = compile_legacy(expr, LegacyScope(names=Names(r, p, {}), deref=p.deref))
                values[name], missing[name] = v.col.cast("variant") if v.kind != "dyn" else v.col, v.col.isNull()
            given = F.try_variant_get("fields", "$", "map<string,variant>")
            more = F.map_from_entries(F.array_compact(F.array(*[F.when(~missing[n], F.struct(F.lit(n), v)) for n, v in values.items()])))
            merged = F.to_variant_object(F.map_concat(F.map_filter(given, lambda k, _: ~F.array_contains(F.map_keys(more), k)), more))
            r = r.with_df(p.df.withColumn("fields", F.when(own, merged).otherwise(F.col("fields"))))
        return r

    @traced
    def read(self, path: str) -> dict:
        """One record: path, fields, types, body, revision."""
        row = self.records().df.where(F.col("path") == path).select("path", F.to_json("fields").alias("f"), F.to_json("raw").alias("r"), "types", "body", "revision", "mtime", "size").first()
        if row is None:
            raise CollectionError("file_not_found", f"{path!r} is not a record")
        return {"path": path, "frontmatter": json.loads(row["f"]), "raw": json.loads(row["r"]), "types": row["types"], "body": row["body"], "revision": row["revision"], "file": {"path": path, "mtime": row["mtime"], "size": row["size"]}}

    @traced
    def query(self, query: dict, **options) -> Result:
        if self.config.timezone and "timezone_name" not in options:
            options["timezone_name"] = self.config.timezone
        return execute(self.records(), query, **options)

    @traced
    def query_legacy(self, query: dict) -> LegacyResult:
        enums = {n: [str(v) for v in d["values"]] for t in self.types.values() for n, d in t.fields.items() if d.get("values")}
        return execute_legacy(self.records(), query, enums=enums, where_language="cel" if self.config.strict_profile else "legacy")

    @traced
    def evaluate(self, path: str, expression: str, zone: str = "UTC"):
        """An expression's value for one record (None for null and errors)."""
        q = execute(self.records(), {"where": f"file.path == {json.dumps(path)}", "select": [{"name": "value", "expr": expression}]}, timezone_name=zone)
        row = q.values.first()
        value = row["value"] if row else None
        return value.toPython() if hasattr(value, "toPython") else value

    @traced
    def backlinks(self, path: str) -> list[str]:
        row = L.backlinks(self.records()).where(F.col("path") == path).first()
        return list(row["backlinks"]) if row else []

    @traced
    def views(self) -> Views:
        """The records of the view contract (or type ``view``) as a catalogue."""
        found = self.records().df.where(F.exists("types", lambda t: t.rlike(r"(^|\.)view$"))).select("path", F.to_json("fields").alias("f"))
        return Views({r["path"]: json.loads(r["f"]) for r in found.toLocalIterator()})

    @traced
    def contract(self, name: str) -> DataFrame:
        return contract_view(self.records(), self.contracts[name])

    # --- checking ---

    @traced
    def validate(self, scope: str = "collection") -> DataFrame:
        """The issue table.  ``scope='records'`` adds the checks of single records: file names, links, contracts."""
        r = raw = self.records(defaults=False)
        own = [Type(t.name, t.fields, t.strict or self.config.strict) for t in self.types.values()]
        parts = [validate(r, own)]
        for t in self.types.values():
            if t.schema is not None:
                parts.append(schema_issues(raw, t.schema, [t.name], part="raw"))
            for u in map(dict, t.unique):
                types = None if u.get("scope") == "all" else [t.name]
                parts.append(unique_issues(r, u["field"], types=types, path_glob=u.get("path_glob") if u.get("scope") == "path_glob" else None))
            if t.path_pattern and scope == "records":
                named = t.path_pattern.rsplit("/", 1)[-1].removesuffix(".md")
                parts.append(filename_issues(r.with_df(r.df.where(F.array_contains("types", t.name))), named))
            if scope == "records":
                for name, rule in t.links.items():
                    if rule.get("validate_exists"):
                        target = rule.get("target_type")
                        parts.append(link_issues(r, name.removesuffix("[]"), target if isinstance(target, str) else None))
        if not self.config.strict_profile and self.config.id_field:
            parts.append(unique_issues(r, self.config.id_field, code="duplicate_id"))
        if scope == "records":
            parts += [contract_issues(contract_view(r, c), c) for c in self.contracts.values() if c.implementations]
        out = self.spark.createDataFrame([], ISSUES)
        for p in parts:
            out = out.unionByName(p)
        return out

    # --- changing ---

    def _checked(self, path: str) -> str:
        if path.startswith("/") or ".." in path.split("/") or not path.strip():
            raise CollectionError("path_traversal", f"{path!r} leads outside the collection")
        return path

    def _stored(self, path: str) -> tuple[dict, str, bytes]:
        if not self.files.exists(self._checked(path)):
            raise CollectionError("file_not_found", f"{path!r} is not a record")
        data = self.files.read(path)
        fields, body, code, message = parse_record(data, path.endswith(".base"))
        if code:
            raise CollectionError("invalid_frontmatter", message)
        return json.loads(fields), body, data

    def _write(self, path: str, fields: dict, body: str) -> None:
        self.refresh()
        self.files.write(path, render_record(fields, body, nulls=self.config.write_nulls, empty_lists=self.config.write_empty_lists).encode())

    def _types_of(self, fields: dict) -> list[str]:
        for key in self.config.explicit_type_keys:
            if isinstance(fields.get(key), list):
                return [str(x).lower() for x in fields[key]]
        for key in self.config.explicit_type_keys:
            if isinstance(fields.get(key), str):
                return [fields[key].lower()]
        return []

    def _generated(self, d: dict, fields: dict, type_name: str, name: str):
        how, now = d["generated"], datetime.now(timezone.utc)
        if how == "uuid":
            return str(uuid.uuid4())
        if how == "ulid":
            return _ulid(now)
        if how in ("now", "now_on_write"):
            return now.strftime("%Y-%m-%dT%H:%M:%S.") + f"{now.microsecond // 1000:03d}Z" if d.get("type") != "date" else now.date().isoformat()
        if how == "random":
            return secrets.token_hex(8)
        if how == "sequence" or isinstance(how, dict) and "sequence" in how:
            from .records import path_of_field

            r = self.records()
            v = path_of_field(F.col("fields"), r.type_of("fields"), name)
            top = r.df.where(F.array_contains("types", type_name)).agg(F.max(as_kind(v, "int"))).first()[0]
            start = (how.get("sequence") or {}).get("start", 1) if isinstance(how, dict) and isinstance(how.get("sequence"), dict) else 1
            return start if top is None else top + 1
        if isinstance(how, dict) and "from" in how:
            source = fields.get(how["from"])
            return None if source is None else _transformed(str(source), how.get("transform"))
        return None

    @traced
    def create(self, fields: dict | None = None, *, path: str | None = None, type: str | None = None, types: list[str] = (), body: str = "") -> str:
        """Stores a new record; gives its path."""
        out = dict(fields or {})
        names = [t.lower() for t in ([type] if type else []) + list(types)] or self._types_of(out)
        for n in names:
            if n not in self.types:
                raise CollectionError("unknown_type", f"{n!r} is no type")
        if names and self.config.explicit_type_keys:
            many = next((k for k in self.config.explicit_type_keys if k.endswith("s")), self.config.explicit_type_keys[0])
            single = next((k for k in self.config.explicit_type_keys if not k.endswith("s")), many)
            out.setdefault(single if len(names) == 1 else many, names[0] if len(names) == 1 else names)
        self._run_lifecycle(names, "on_create", out)
        for n in names:
            for f, d in self.types[n].fields.items():
                if f in out:
                    continue
                if d.get("generated"):
                    got = self._generated(d, out, n, f)
                    out[f] = got if got is not None else d.get("default")
                elif "default" in d and self.config.write_defaults:
                    out[f] = d["default"]
        if path is None:
            pattern = next((self.types[n].path_pattern for n in names if self.types[n].path_pattern), None)
            if pattern is None:
                raise CollectionError("path_required", "no path is given and no type has a path pattern")
            keys = re.findall(r"\{(\w+)\}", pattern)
            if missing := [k for k in keys if out.get(k) in (None, "")]:
                raise CollectionError("path_required", f"the path pattern needs {missing[0]!r}")
            path = re.sub(r"\{(\w+)\}", lambda m: str(out[m.group(1)]), pattern)
        if "." not in path.rsplit("/", 1)[-1]:
            path += ".md"
        if self.files.exists(self._checked(path)):
            raise CollectionError("path_conflict", f"{path!r} exists")
        self._refuse(path, out, names)
        self._write(path, out, body)
        return path

    def _run_lifecycle(self, names: list[str], event: str, fields: dict, old: dict | None = None) -> None:
        now = datetime.now(timezone.utc)
        stamp = now.strftime("%Y-%m-%dT%H:%M:%S.") + f"{now.microsecond // 1000:03d}Z"
        for n in sorted(set(names)):
            actions = self.types[n].lifecycle.get(event) or [] if n in self.types else []
            for a in actions if isinstance(actions, list) else [actions]:
                if a.get("if") and not self._guard(a["if"], fields):
                    continue
                before = json.loads(json.dumps(fields, default=str))
                for ref, spec in (a.get("set") or {}).items():
                    if not isinstance(spec, dict):
                        field_refs.put(fields, ref, spec)
                    elif spec.get("now") or spec.get("today"):
                        field_refs.put(fields, ref, stamp if spec.get("now") else stamp[:10])
                    elif spec.get("uuid") or spec.get("ulid"):
                        field_refs.put(fields, ref, str(uuid.uuid4()) if spec.get("uuid") else _ulid(now))
                    elif "slugify" in spec:
                        source = field_refs.get(before, spec["slugify"])
                        field_refs.put(fields, ref, _transformed(source, "slugify") if isinstance(source, str) else None)
                    elif "copy" in spec:
                        source = field_refs.get(before, spec["copy"])
                        field_refs.remove(fields, ref) if source is field_refs.MISSING else field_refs.put(fields, ref, source)
                    else:
                        field_refs.put(fields, ref, spec.get("literal"))

    def _guard(self, expr: str, fields: dict) -> bool:
        one = self.spark.createDataFrame([(json.dumps(fields, default=str),)], "j string").select(F.parse_json("j").alias("fields"))
        from .records import field_value, map_value

        t = one.schema["fields"].dataType
        scope = Scope(names=lambda n: map_value(F.col("fields"), t) if n in ("record", "raw") else field_value(F.col("fields"), t, n))
        return one.select(as_kind(compile_expression(expr, scope), "bool")).first()[0] is True

    def _refuse(self, path: str, fields: dict, names: list[str]) -> None:
        """Raises where validation is ``error`` and the record has errors."""
        if self.config.validation != "error" or not names:
            return
        df = self.spark.createDataFrame([(path, names, "", json.dumps(fields, default=str))], "path string, types array<string>, body string, j string")
        none = lambda k: F.lit(None).cast(k)
        one = Records(df.select("path", "types", "body", F.parse_json("j").alias("fields"), F.parse_json("j").alias("raw"), none("timestamp").alias("mtime"), none("timestamp").alias("ctime"), none("bigint").alias("size"), none("string").alias("revision")))
        found = [r.asDict() for r in validate(one, [Type(n, self.types[n].fields, self.types[n].strict) for n in names if n in self.types]).where("severity = 'error'").collect()]
        for n in names:
            if n in self.types and self.types[n].schema is not None:
                found += [r.asDict() for r in schema_issues(one, self.types[n].schema, [n]).collect()]
        constrained = [(n, dict(u)) for n in names if n in self.types for u in self.types[n].unique if field_refs.get(fields, dict(u)["field"]) not in (None, field_refs.MISSING)]
        for n, u in constrained:  # only a constrained value that is there costs a scan
            from .records import path_of_field

            r = self.records()
            v = path_of_field(F.col("fields"), r.type_of("fields"), u["field"])
            same = r.df.where((F.col("path") != path) & (F.to_json(v.col) == F.lit(json.dumps(field_refs.get(fields, u["field"])))))
            if u.get("scope") != "all":
                same = same.where(F.array_contains("types", n))
            if not same.isEmpty():
                found.append({"code": "duplicate_value", "field": u["field"], "path": path})
        if found:
            raise CollectionError("validation_failed", f"{path} has {len(found)} errors", found)

    @traced
    def update(self, path: str, fields: dict | None = None, *, unset: list[str] = (), body: str | None = None, if_revision: str | None = None) -> None:
        import hashlib

        stored, old_body, data = self._stored(path)
        if if_revision is not None and if_revision != "sha256:" + hashlib.sha256(data).hexdigest():
            raise CollectionError("concurrent_modification", f"{path!r} has changed")
        new = {**stored, **(fields or {})}
        for ref in unset:
            field_refs.remove(new, ref)
        names = self._types_of(new) or next((r["types"] for r in self.records(defaults=False).df.where(F.col("path") == path).select("types").collect()), [])
        self._run_lifecycle(names, "on_update", new, stored)
        for n in names:
            for f, d in self.types[n].fields.items() if n in self.types else ():
                if d.get("generated") == "now_on_write":
                    new[f] = self._generated(d, new, n, f)
        self._refuse(path, new, names)
        self._write(path, new, old_body if body is None else body)

    @traced
    def delete(self, path: str) -> list[tuple[str, str]]:
        """Gives the links (path, source) that it breaks."""
        self._stored(path)
        _, broken = W.delete(self.records(), path)
        lost = [tuple(r) for r in broken.collect()]
        self.files.delete(path)
        self.refresh()
        return lost

    @traced
    def rename(self, old: str, new: str) -> list[str]:
        """Moves a record and rewrites references; gives the paths of the records that were changed."""
        self._stored(old)
        if self.files.exists(self._checked(new)):
            raise CollectionError("path_conflict", f"{new!r} exists")
        r = self.records(defaults=False)
        changed: list[str] = []
        if self.config.rename_update_refs:
            now = W.rename(r, old, new).df
            before = r.df.select(F.when(F.col("path") == old, new).otherwise(F.col("path")).alias("__p"), F.to_json("raw").alias("__f"), F.col("body").alias("__b"))
            differs = (F.to_json("raw") != F.col("__f")) | (F.col("body") != F.col("__b"))
            rows = now.join(before, F.col("path") == F.col("__p")).where(differs).select("path", F.to_json("raw").alias("f"), "body").collect()
        else:
            rows = []
        self.files.write(new, self.files.read(old))
        self.files.delete(old)
        self.refresh()
        for row in rows:
            self._write(row["path"], json.loads(row["f"]), row["body"])
            changed.append(row["path"])
        return sorted(changed)

    @traced
    def batch_update(self, fields: dict, where: str | dict | None = None, dry_run: bool = False) -> list[str]:
        """Sets fields of all records that match; all are checked before any is written."""
        r = self.records()
        paths = [x["path"] for x in r.df.where(W.condition(r, where)).select("path").orderBy("path").collect()]
        ready = []
        for p in paths:
            stored, body, _ = self._stored(p)
            new = {**stored, **fields}
            self._refuse(p, new, self._types_of(new))
            ready.append((p, new, body))
        if not dry_run:
            self._all_or_nothing([lambda p=p, n=new, b=body: self._write(p, n, b) for p, new, body in ready])
        return paths

    @traced
    def batch_delete(self, where: str | dict | None = None, dry_run: bool = False) -> list[str]:
        r = self.records()
        paths = [x["path"] for x in r.df.where(W.condition(r, where)).select("path").orderBy("path").collect()]
        if not dry_run:
            self._all_or_nothing([lambda p=p: self.files.delete(p) for p in paths])
        return paths

    def _all_or_nothing(self, steps: list) -> None:
        """Runs actions; a failing one takes back what those before it changed, and so does the next ``open`` if this process ends first."""
        self.refresh()
        with self._journalled():
            for act in steps:
                act()

    @contextmanager
    def _journalled(self, keep: bool = True):
        """Writes within are taken back on an error, or at the end if they aren't to be kept."""
        if self.files.journal is not None:  # within another batch
            yield
            return
        journal = self.files.journal = Journal(self.files)
        done = False
        try:
            yield
            done = keep
        finally:
            self.files.journal = None
            if done:
                journal.close()
            elif journal.seen:
                undo(self.files, journal.name)
            self.refresh()

    OPERATIONS = ("create", "update", "delete", "rename")

    @traced
    def batch(self, operations: list[dict], *, dry_run: bool = False, allow_partial: bool = False) -> list[dict]:
        """Runs operations in order; each has ``op`` (create, update, delete, rename) and that method's arguments.

        Gives one result per operation: ``ok``, and ``value`` or ``code`` and ``message``.  The first failure
        takes back all, unless ``allow_partial``, which leaves out what fails and what comes to
        a path that a failed operation was about.  ``dry_run`` runs them all and takes everything back.
        """
        for o in operations:
            if o.get("op") not in self.OPERATIONS:
                raise CollectionError("unknown_operation", f"{o.get('op')!r} is no operation")
        results, failed = [], set()

        def about(o: dict) -> set:
            return {o[k] for k in ("path", "old", "new") if isinstance(o.get(k), str)}

        with self._journalled(keep=not dry_run):
            for o in operations:
                if about(o) & failed:
                    results.append({"ok": False, "code": "batch_failed", "message": "depends on an operation that failed"})
                    failed |= about(o)
                    continue
                try:
                    with self._undone_alone():
                        results.append({"ok": True, "value": getattr(self, o["op"])(**{k: v for k, v in o.items() if k != "op"})})
                except CollectionError as e:
                    if not allow_partial:
                        raise CollectionError("batch_failed", f"{o['op']}: {e}", {"code": e.code, "operation": o}) from e
                    failed |= about(o)
                    results.append({"ok": False, "code": e.code, "message": str(e)})
        return results

    @contextmanager
    def _undone_alone(self):
        """One operation of a batch: what it wrote before it failed is taken back, the batch's journal stays."""
        outer, self.files.journal = self.files.journal, Journal(self.files)
        inner, good = self.files.journal, False
        try:
            yield
            good = True
        finally:
            self.files.journal = outer
            if good:
                outer.adopt(inner)
            elif inner.seen:
                undo(self.files, inner.name)
                self.refresh()

    @traced
    def update_many(self, updates: list[dict], *, dry_run: bool = False, allow_partial: bool = False) -> list[dict]:
        """``batch`` of updates: each a path with fields, unset, body or if_revision."""
        return self.batch([{"op": "update", **u} for u in updates], dry_run=dry_run, allow_partial=allow_partial)

    @traced
    def create_type(self, name: str, definition: dict) -> None:
        import yaml

        text = "---\n" + yaml.safe_dump({"name": name, **definition}, sort_keys=False, allow_unicode=True) + "---\n"
        made = parse_type(text, name)
        at = f"{self.config.types_folder}/{name}.md"
        if self.files.exists(at):
            raise CollectionError("path_conflict", f"{at!r} exists")
        self.files.write(at, text.encode())
        self.types = inherit({**self.types, made.name: made})


def _ulid(now: datetime) -> str:
    digits = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
    n = (int(now.timestamp() * 1000) << 80) | secrets.randbits(80)
    return "".join(digits[(n >> (5 * i)) & 31] for i in range(25, -1, -1))


def _transformed(text: str, how: str | None) -> str:
    import unicodedata

    if how == "slugify":
        bare = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()
        return re.sub(r"[^a-z0-9]+", "-", bare).strip("-")
    return text.lower() if how == "lowercase" else text.upper() if how == "uppercase" else text
