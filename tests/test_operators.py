import pytest
from pyspark.sql import functions as F

from fernglass.functions.globs import glob_regex
from fernglass.operators import links as L
from fernglass.operators import writes as W
from fernglass.operators.changes import snapshot_diff
from fernglass.operators.contracts import Contract, contract_issues, contract_view
from fernglass.operators.jsonschema import SchemaError, check_schema, schema_issues
from fernglass.operators.rules import Type, link_issues, merge_types, unique_issues, validate
from fernglass.operators.structured_where import structured_where
from fernglass.records import path_of_field
from tests.helpers import native, variant_records


def resolved(spark, r, link, src, target_type=None):
    df = spark.createDataFrame([(link, src)], "link string, src string")
    return L.resolve(df, F.col("link"), F.col("src"), r, "r", target_type).first()["r"]


def test_ids_come_before_names(spark):
    r = variant_records(spark, {"by-name/TASK-1.md": {"id": "OTHER"}, "by-id/record.md": {"id": "TASK-1"}}, id_field="id")
    assert resolved(spark, r, "[[TASK-1]]", "x.md")["path"] == "by-id/record.md"


def test_ambiguous_ids(spark):
    r = variant_records(spark, {"a.md": {"id": 42}, "b.md": {"id": "42"}}, id_field="id")
    got = resolved(spark, r, "[[42]]", "x.md")
    assert got["path"] is None and got["ambiguous"]


def test_wrong_type_is_told_from_missing(spark):
    r = variant_records(spark, {"record.md": {}}, types={"record.md": ["note"]})
    assert resolved(spark, r, "[[record]]", "x.md", "task")["wrong_type"]
    assert not resolved(spark, r, "[[gone]]", "x.md", "task")["wrong_type"]
    assert resolved(spark, r, "[[record]]", "x.md", "note")["path"] == "record.md"


def test_ties(spark):
    r = variant_records(spark, {p: {} for p in ("deep/a/record.md", "near/record.md", "other/record.md")})
    assert resolved(spark, r, "[[record]]", "near/from.md")["path"] == "near/record.md"
    assert resolved(spark, r, "[[record]]", "from.md")["path"] == "near/record.md"


@pytest.mark.parametrize("link, src, want", [
    ("[[./target]]", "notes/a.md", "notes/target.md"), ("[x](target.md)", "notes/a.md", "notes/target.md"), ("../assets/image.png", "notes/a.md", "assets/image.png"), ("[[unterminated", "notes/a.md", None),
    ("/notes/target.md", "x/y.md", "notes/target.md"), ("[[notes/target|alias]]", "x/y.md", "notes/target.md"), ("[[target#part]]", "x.md", "notes/target.md"), ("[x](/notes/target.md#h)", "x/y.md", "notes/target.md"),
    ("../../out.md", "notes/a.md", None), ("target", "x.md", "notes/target.md"),
])
def test_forms(spark, link, src, want):
    assets = spark.createDataFrame([("assets/image.png",)], "path string")
    assert resolved(spark, variant_records(spark, {"notes/target.md": {}, "notes/a.md": {}}, assets=assets), link, src)["path"] == want


def test_parse_link(spark):
    one = lambda s: spark.createDataFrame([(s,)], "s string").select(L.parse_link(F.col("s")).alias("p")).first()["p"]
    p = one("![[a/b#h|Alias|x]]")
    assert (p["target"], p["anchor"], p["alias"], p["format"], p["is_embed"], p["valid"]) == ("a/b", "h", "Alias|x", "wikilink", True, True)
    p = one("[a [b] c](u(1).md#z)")
    assert (p["target"], p["anchor"], p["alias"], p["format"]) == ("u(1).md", "z", "a [b] c", "markdown")
    for bad in ("[[", "[[ ]]", "[[|]]", "[[#]]", "[[a\nb]]", "[x]( )"):
        assert not one(bad)["valid"], bad


def test_scan_body():
    links, tags = L.scan_body("a [[x]] `[[no]]` #t1 (#no)\n```\n[[no]] #no\n```\n    [[no]]\n\\[[no]] [m](u.md) #ffaa00 #t1 #a/b\n")
    assert links == ["[[x]]", "[m](u.md)"] and tags == ["t1", "a/b"]


def test_backlinks_and_broken(spark):
    r = variant_records(spark, {"a.md": {"to": "[[b]]"}, "b.md": {}, "c.md": {}}, bodies={"c.md": "see [[b]] [[b|again]] [[gone]] and [[c]]"})
    assert {x["path"]: x["backlinks"] for x in L.backlinks(r).collect()} == {"b.md": ["[[a.md]]", "[[c.md]]"], "c.md": ["[[c.md]]"]}
    assert [tuple(x) for x in L.broken_links(r).collect()] == [("c.md", "[[gone]]")]


@pytest.mark.parametrize("pattern, hits, misses", [
    ("a/**/*.md", ["a/x.md", "a/b/c/x.md"], ["b/x.md", "a/x.txt"]), ("**", ["a", "a/b"], []), ("*.md", ["x.md"], ["a/x.md"]), ("a?c", ["abc", "a😀c"], ["ac", "a/c"]), ("[!a]b", ["xb"], ["ab", "/b"]), ("x[ab].(y)", ["xa.(y)"], ["xc.(y)"]),
])
def test_globs(spark, pattern, hits, misses):
    df = spark.createDataFrame([(p,) for p in hits + misses], "p string")
    assert sorted(x["p"] for x in df.where(F.col("p").rlike(glob_regex(pattern))).collect()) == sorted(hits)


@pytest.mark.parametrize("where, want", [
    ({"meta.priority": {"gte": 3, "lt": 4}, "tags": {"containsAll": ["alpha", "beta"]}, "title": {"matches": "^Task \\d+$"}}, True), ({"title": {"exists": True}, "nope": {"exists": False}}, True), ({"nul": {"exists": True}}, True),
    ({"nul": {"eq": None}}, False), ({"nul": None}, True), ({"nope": {"neq": 1}}, False), ({"meta.priority": {"in": [1, 3]}}, True), ({"or": [{"title": "x"}, {"not": {"meta.priority": 4}}]}, True), ({"title": {"gt": 1}}, False),
    ({"title": {"startsWith": "Task", "ends_with": "42", "contains": "sk 4"}}, True), ({"tags": {"containsAny": ["z", "beta"]}}, True), ({"meta.priority": {"neq": 4}}, True), ({"title": {"weird": 1}}, False), ({"meta": {"eq": {"priority": 3}}}, True),
    ({"title": {"matches": "("}}, False), ({"tags": ["alpha", "beta"]}, True), ({"and": []}, True), ({"or": []}, False),
])
def test_structured_where(spark, where, want):
    r = variant_records(spark, {"a.md": {"meta": {"priority": 3}, "tags": ["alpha", "beta"], "title": "Task 42", "nul": None}})
    t = r.type_of("fields")
    from fernglass.operators.membership import present

    got = r.df.select(structured_where(where, lambda ref: path_of_field(F.col("fields"), t, ref), present=lambda ref: present(F.col("fields"), t, ref)).alias("x")).first()["x"]
    assert got is want


def test_field_rules(spark):
    rows = {
        "ok.md": {"title": "abc", "n": "12", "when": "2024-02-29", "tags": ["a", "b"], "ref": "[[x]]", "box": {"w": 1}},
        "bad.md": {"title": "a", "n": 1.5, "when": "2024-02-30", "tags": ["a", "a", 5.5, {}], "ref": "[[x", "box": {}, "extra": 1, "flag": "yes", "t": "25:00", "dt": "2024-01-01T10:00", "level": "mid"},
    }
    fields = {
        "title": {"type": "string", "required": True, "min_length": 2, "max_length": 5, "pattern": "^[a-z]+$"}, "n": {"type": "integer", "min": 1, "max": 20}, "when": {"type": "date"},
        "tags": {"type": "list", "items": {"type": "string"}, "unique": True, "max_items": 3}, "ref": {"type": "link"}, "box": {"type": "object", "fields": {"w": {"type": "number", "required": True}}},
        "flag": {"type": "boolean"}, "t": {"type": "time"}, "dt": {"type": "datetime"}, "level": {"type": "enum", "values": ["low", "high"]}, "owner": {"type": "string", "required": True}, "old": {"deprecated": True},
    }
    r = variant_records(spark, rows, types={"ok.md": ["t"], "bad.md": ["t", "strange"]})
    got = {(x["path"], x["code"], x["field"]) for x in validate(r, [Type("t", fields, strict="warn")]).collect()}
    assert got == {("ok.md", "missing_required", "owner")} | {("bad.md", c, f) for c, f in (
        ("unknown_type", None), ("string_too_short", "title"), ("not_integer", "n"), ("invalid_date", "when"), ("list_too_long", "tags"), ("list_duplicate", "tags"), ("list_item_invalid", "tags"),
        ("invalid_link", "ref"), ("missing_required", "box.w"), ("unknown_field", "extra"), ("type_mismatch", "flag"), ("invalid_time", "t"), ("invalid_enum", "level"), ("missing_required", "owner"),
    )}


def test_merged_types():
    a, b = Type("a", {"n": {"type": "number", "min": 1, "max": 9}, "s": {"type": "enum", "values": ["x", "y"]}}), Type("b", {"n": {"type": "number", "min": 3, "required": True}, "s": {"type": "enum", "values": ["z"]}})
    merged, conflicts = merge_types([a, b])
    assert merged.fields["n"] == {"type": "number", "min": 3, "max": 9, "required": True}
    assert [c["field"] for c in conflicts] == ["s"]


def test_json_schema(spark):
    schema = {
        "type": "object", "required": ["a"], "additionalProperties": False,
        "properties": {
            "a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "items": {"type": "string"}, "uniqueItems": True, "maxItems": 2}, "c": {"oneOf": [{"type": "string"}, {"type": "number"}]}, "d": {"format": "date"},
            "e": {"$ref": "#/$defs/e"}, "f": {"const": {"x": 1}}, "g": {"enum": [1, "one"]}, "h": {"not": {"type": "null"}}, "i": {"type": ["string", "null"]}, "j": {"multipleOf": 0.5},
        },
        "$defs": {"e": {"type": "object", "properties": {"deep": {"minLength": 2}}, "required": ["deep"]}},
        "if": {"properties": {"a": {"const": 5}}}, "then": {"required": ["b"]}, "else": {"properties": {"a": {"maximum": 9}}},
    }
    rows = {
        "ok.md": {"a": 5, "b": ["x"], "c": 1, "d": "2024-02-29", "e": {"deep": "xx"}, "f": {"x": 1}, "g": "one", "h": 1, "i": None, "j": 1.5},
        "bad.md": {"a": 0.5, "b": ["x", "x", 1], "c": True, "d": "2024-02-30", "e": {"deep": "x"}, "f": {"x": 2}, "g": 2, "h": None, "i": 1, "j": 1.3, "z": 1}, "none.md": {}, "five.md": {"a": 5}, "ten.md": {"a": 10},
    }
    got = {(x["path"], x["code"], x["field"]) for x in schema_issues(variant_records(spark, rows), schema).collect()}
    assert got == {("bad.md", c, f) for c, f in (
        ("schema_type", "a"), ("schema_minimum", "a"), ("schema_max_items", "b"), ("schema_unique_items", "b"), ("schema_items", "b"), ("schema_one_of", "c"), ("format_invalid", "d"), ("schema_min_length", "e.deep"),
        ("schema_const", "f"), ("schema_enum", "g"), ("schema_not", "h"), ("schema_type", "i"), ("schema_multiple_of", "j"), ("schema_additional_properties", "z"),
    )} | {("none.md", "schema_required", "a"), ("none.md", "schema_required", "b"), ("five.md", "schema_required", "b"), ("ten.md", "schema_maximum", "a")}
    with pytest.raises(SchemaError):
        check_schema({"properties": {"a": {"$ref": "#/$defs/none"}}})
    with pytest.raises(SchemaError):
        check_schema({"pattern": "("})


def test_contract_union(spark):
    c = Contract("note", {"type": "object", "required": ["title"], "properties": {"title": {"type": "string", "minLength": 1}}}, {"personal_note": {"title": "title"}, "work_note": {"title": "summary"}})
    rows = {"work.md": {"summary": "Work note"}, "invalid.md": {"summary": ""}, "mine.md": {"title": "Mine"}}
    r = variant_records(spark, rows, types={"work.md": ["work_note"], "invalid.md": ["work_note"], "mine.md": ["personal_note"]})
    view = contract_view(r, c)
    assert {x["path"]: native(x["title"]) for x in view.collect()} == {"work.md": "Work note", "invalid.md": "", "mine.md": "Mine"}
    assert [(x["path"], x["code"], x["field"]) for x in contract_issues(view, c).collect()] == [("invalid.md", "data_contract_record_invalid", "title")]


def test_unique_and_link_rules(spark):
    r = variant_records(spark, {"a/1.md": {"id": "x", "to": "[[gone]]"}, "a/2.md": {"id": "x", "to": "[[1]]"}, "b/3.md": {"id": "x", "to": "../../o.md"}, "b/4.md": {}}, types={"a/1.md": ["t"], "a/2.md": ["t"], "b/3.md": ["u"]})
    assert sorted(x["path"] for x in unique_issues(r, "id").collect()) == ["a/2.md", "b/3.md"]
    assert [x["path"] for x in unique_issues(r, "id", types=["t"]).collect()] == ["a/2.md"]
    assert [x["path"] for x in unique_issues(r, "id", path_glob="b/*").collect()] == []
    assert {(x["path"], x["code"]) for x in link_issues(r, "to").collect()} == {("a/1.md", "link_not_found"), ("b/3.md", "path_traversal")}
    assert {(x["path"], x["code"]) for x in link_issues(r, "to", "u").collect()} >= {("a/2.md", "link_wrong_type")}


def test_writes(spark):
    r = variant_records(spark, {"a.md": {"n": 1, "s": "x"}, "b.md": {"n": 5}, "c.md": {"n": None}})
    vals = lambda x: {p: native(f) for p, f in x.df.select("path", "fields").collect()}
    assert vals(W.batch_update(r, {"s": "new"}, "n > 2"))["b.md"] == {"n": 5, "s": "new"}
    assert set(vals(W.batch_delete(r, {"n": {"lt": 3}}))) == {"b.md", "c.md"}
    filled = vals(W.backfill(r, {"n": 0, "s": "d"}))
    assert filled["c.md"] == {"n": None, "s": "d"} and filled["a.md"]["s"] == "x"
    assert {p: v["seq"] for p, v in vals(W.backfill(r, sequence="seq")).items()} == {"a.md": 1, "b.md": 2, "c.md": 3}
    after = vals(W.lifecycle(r, [{"if": "n == 5", "set": {"slug": {"slugify": "t"}, "copy": {"copy": "n"}}}, {"set": {"k": {"literal": True}}}]))
    assert after["b.md"]["copy"] == 5 and after["a.md"] == {"n": 1, "s": "x", "k": True}
    updates = spark.createDataFrame([("b.md", "u")], "path string, s string")
    assert vals(W.apply_updates(r, updates))["b.md"] == {"n": 5, "s": "u"}
    with pytest.raises(W.WriteError) as e:
        W.delete(r, "gone.md")
    assert e.value.code == "file_not_found"
    with pytest.raises(W.WriteError) as e:
        W.create(r, r.df.limit(1))
    assert e.value.code == "path_conflict"


def test_rename_rewrites_links(spark):
    r = variant_records(spark, {"notes/a.md": {}, "b.md": {"to": "[[a|Alias]]"}, "sub/c.md": {}}, bodies={"b.md": "[[notes/a#h]] and [x](notes/a.md) and [[a]]", "sub/c.md": "[[../notes/a]] [[b]]"})
    out = W.rename(r, "notes/a.md", "moved/z.md")
    rows = {x["path"]: x for x in out.df.collect()}
    assert set(rows) == {"moved/z.md", "b.md", "sub/c.md"}
    assert rows["b.md"]["body"] == "[[moved/z#h]] and [x](./moved/z.md) and [[z]]"
    assert rows["sub/c.md"]["body"] == "[[../moved/z]] [[b]]"
    assert native(rows["b.md"]["fields"]) == {"to": "[[z|Alias]]"}
    for new, code in (("../x.md", "path_traversal"), ("b.md", "path_conflict")):
        with pytest.raises(W.WriteError) as e:
            W.rename(r, "notes/a.md", new)
        assert e.value.code == code


def test_delete_reports_backlinks(spark):
    r = variant_records(spark, {"a.md": {}, "b.md": {}}, bodies={"b.md": "[[a]]", "a.md": "[[a]]"})
    left, broken = W.delete(r, "a.md")
    assert [x["path"] for x in left.df.collect()] == ["b.md"] and [tuple(x) for x in broken.collect()] == [("a.md", "[[b.md]]")]


def test_slugify(spark):
    df = spark.createDataFrame([("Crème  Brûlée!",), (None,), ("--",)], "s string")
    assert [x[0] for x in df.select(W.slugify(F.col("s"))).collect()] == ["creme-brulee", None, ""]


def test_snapshot_diff(spark):
    old = variant_records(spark, {"same.md": {"a": 1}, "mod.md": {"a": 1}, "gone.md": {"a": 2}, "old-name.md": {"a": 3}}, types={"same.md": ["x"]})
    new = variant_records(spark, {"same.md": {"a": 1}, "mod.md": {"a": 9}, "fresh.md": {"a": 4}, "new-name.md": {"a": 3}}, types={"same.md": ["y"]})
    got = {tuple(x) for x in snapshot_diff(old, new).collect()}
    assert got == {("file_modified", "mod.md", None), ("file_deleted", "gone.md", None), ("file_created", "fresh.md", None), ("file_renamed", "new-name.md", "old-name.md"), ("type_changed", "same.md", None)}


def test_lookups_hold_the_keys_that_are_asked_for(spark):
    r = variant_records(spark, {f"many/r{i}.md": {} for i in range(300)} | {"a.md": {"to": "[[many/r7]]"}})
    asked = spark.createDataFrame([("pmany/r7",), ("nr9",), ("pno",)], "key string")
    keys = {x["key"] for x in L.lookups(r, asked=asked)[0].collect()}
    assert {"pmany/r7", "nr9"} <= keys and len(keys) < 30  # of 903


def test_repeated_links_resolve_as_single_ones(spark):
    r = variant_records(spark, {p: {"id": i} for p, i in {"x/n.md": "one", "y/n.md": "two", "x/y/n.md": "two", "x/m.md": "n", "top.md": "", "k.md": "k"}.items()}, id_field="id")
    texts = ["[[n]]", "[[x/n]]", "[[./n]]", "[[../n]]", "[[one]]", "[[two]]", "n", "./n.md", "[a](n.md)", "[[/x/n]]", "[[top]]", "[[gone]]", "[[", "", None, "[[k]]"]
    df = spark.createDataFrame([(s, t) for s in ("x/m.md", "y/q.md", "top.md", "x/y/z.md") for t in texts], "src string, link string")
    df = df.union(df)
    both = [sorted(map(str, f(df, F.col("link"), F.col("src"), r, "r").collect())) for f in (L.resolve, L.resolve_repeated)]
    assert both[0] == both[1] and len(both[0]) == 2 * 4 * len(texts)
