"""Saved views: records that hold a query and its named variants, executed through the canonical planner."""

from __future__ import annotations

import json
from datetime import datetime

from ..records import Records
from .query import Diagnostic, QueryError, Result, execute

FROM_VIEW = ("select", "order_by", "group_by", "summaries", "limit", "offset", "include_body", "frontmatter_mode")


def _fail(code: str, message: str) -> QueryError:
    return QueryError([Diagnostic(code, message)])


class Views:
    """A catalogue of view records: path -> {id, name, version, query, views, summary_functions}."""

    def __init__(self, by_path: dict[str, dict]):
        self.by_path = by_path

    def list(self) -> list[dict]:
        """Descriptors, by path."""
        out = []
        for path, v in sorted(self.by_path.items()):
            named = [{"id": n["id"], "name": n.get("name", n["id"]), "properties": [s["name"] if isinstance(s, dict) else s.split(".")[-1] for s in n.get("select", [])]} for n in v.get("views", [])]
            out.append({"id": v["id"], "name": v.get("name", v["id"]), "source": {"path": path}, "views": named})
        return out

    def find(self, identifier: str) -> tuple[str, dict]:
        """By path, else by id."""
        if identifier in self.by_path:
            return identifier, self.by_path[identifier]
        for path, v in sorted(self.by_path.items()):
            if v.get("id") == identifier:
                return path, v
        raise _fail("view_not_found", f"view record {identifier!r} was not found")

    def compose(self, identifier: str, view: str, *, context=..., timezone: str | None = None, limit: int | None = None, offset: int | None = None, render: bool = False) -> tuple[dict, str, dict]:
        """(query object, path of the view record, declaration of ``this``)."""
        path, record = self.find(identifier)
        ids = [v["id"] for v in record.get("views", [])]
        if len(set(ids)) < len(ids):
            raise _fail("invalid_view", f"view record {path!r} has named views with one id")
        named = next((v for v in record.get("views", []) if v["id"] == view), None)
        if named is None:
            raise _fail("view_not_found", f"named view {view!r} was not found in {path!r}")
        if render:
            raise _fail("unsupported_presentation", "views are executed without a presentation")
        shared = record.get("query") or {}
        ours, theirs = shared.get("projections") or {}, named.get("projections") or {}
        for name in ours.keys() & theirs.keys():
            if json.dumps(ours[name], sort_keys=True) != json.dumps(theirs[name], sort_keys=True):
                raise _fail("invalid_view", f"projection {name!r} has conflicting shared and local definitions")
        declared = ((named["context"] if "context" in named else shared.get("context")) or {}).get("this") or {}
        query: dict = {}
        if types := named.get("types", shared.get("types")):
            query["types"] = list(types)
        if timezone:
            query["timezone"] = timezone
        if (this := self._context(path, view, context, declared)) is not None:
            query["context"] = {"this": {"path": this}}
        if ours or theirs:
            query["projections"] = {**ours, **theirs}
        conditions = [w for w in (shared.get("where"), named.get("where")) if w]
        if conditions:
            query["where"] = conditions[0] if len(conditions) == 1 else f"({conditions[0]}) && ({conditions[1]})"
        query.update({k: named[k] for k in FROM_VIEW if k in named})
        if record.get("summary_functions"):
            query["summary_functions"] = record["summary_functions"]
        if limit is not None:
            query["limit"] = limit
        if offset is not None:
            query["offset"] = offset
        return query, path, declared

    @staticmethod
    def _context(path: str, view: str, context, declared: dict) -> str | None:
        if isinstance(context, dict) and isinstance(context.get("path"), str):
            return context["path"]
        if context is None:
            return None
        missing = declared.get("on_missing", "view")
        if missing == "error":
            raise _fail("context_required", f"named view {view!r} needs an invocation context")
        return path if missing == "view" else None

    def execute(self, records: Records, identifier: str, view: str, *, now: datetime | None = None, **options) -> Result:
        query, path, declared = self.compose(identifier, view, **options)
        this = query.get("context", {}).get("this", {}).get("path")
        if this is not None and declared.get("types"):
            wanted = [t.lower() for t in declared["types"]]
            found = records.df.where(records.df["path"] == this).select("types").head(1)
            if not found:
                raise _fail("context_not_found", f"context record {this!r} was not found")
            if not set(wanted) & set(found[0]["types"] or []):
                raise _fail("context_type_mismatch", f"context record {this!r} has none of the allowed types")
        result = execute(records, query, now=now)
        result.view = {"path": path, "id": view}
        return result
