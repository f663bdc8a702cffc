import pytest

from fernglass import observability
from fernglass.collection import Collection, CollectionError
from fernglass.functions import field_refs
from fernglass.sources.config import ConfigError, inherit, parse_config, parse_type

FILES = {
    "collection.yaml": 'spec_version: "0.2.0"\nsettings:\n  default_validation: error\n  exclude: ["drafts"]\n',
    "_types/task.md": """---
name: task
path_pattern: "tasks/{title}.md"
match:
  path_glob: "tasks/**/*.md"
fields:
  title: {type: string, required: true}
  status: {type: enum, values: [open, done], default: open}
  points: {type: integer, min: 0}
  number: {type: integer, generated: sequence}
  code: {type: string, unique: true}
  double: {type: number, computed: "points * 2"}
  project: {type: link}
---
""",
    "_types/sub.md": "---\nname: sub\nextends: task\nfields:\n  extra: {type: boolean}\n---\n",
    "tasks/one.md": '---\ntype: task\ntitle: One\npoints: 3\nnumber: 4\nproject: "[[alpha]]"\n---\nBody one\n',
    "tasks/two.md": "---\ntype: task\ntitle: Two\nstatus: done\npoints: 5\n---\nSee [[one]]\n",
    "alpha.md": "---\ntitle: Alpha\n---\n", "drafts/x.md": "---\ntype: task\n---\n",
}


@pytest.fixture
def c(spark, tmp_path):
    for name, text in FILES.items():
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return Collection.open(spark, str(tmp_path))


def test_open_read_and_query(c):
    one = c.read("tasks/one.md")
    assert one["types"] == ["task"] and one["frontmatter"]["status"] == "open" and "status" not in one["raw"] and one["frontmatter"]["double"] == 6
    q = c.query_legacy({"types": ["task"], "where": "points > 3 && status == \"done\""})
    assert [r["path"] for r in q.rows.collect()] == ["tasks/two.md"]
    assert [r["path"] for r in c.query_legacy({"types": ["task"], "order_by": [{"field": "status", "direction": "desc"}]}).rows.collect()] == ["tasks/two.md", "tasks/one.md"]
    assert c.evaluate("tasks/one.md", "project.asFile().title") == "Alpha"
    assert c.backlinks("tasks/one.md") == ["[[tasks/two.md]]"] and c.backlinks("alpha.md") == ["[[tasks/one.md]]"]
    assert set(c.types["sub"].fields) > {"title", "extra"}


def test_create_update_delete(c):
    path = c.create({"title": "Three", "points": 1, "code": "x"}, type="task")
    assert path == "tasks/Three.md"
    made = c.read(path)
    assert made["frontmatter"]["number"] == 5 and made["frontmatter"]["status"] == "open"
    for args, code in (
        (({"points": 1}, {"type": "task"}), "path_required"), (({"title": "Three"}, {"type": "task"}), "path_conflict"), (({}, {"type": "nope"}), "unknown_type"), (({"title": "x", "points": -1}, {"type": "task"}), "validation_failed"),
        (({"title": "y", "code": "x"}, {"type": "task"}), "validation_failed"), (({}, {"path": "../out.md"}), "path_traversal"),
    ):
        with pytest.raises(CollectionError) as e:
            c.create(args[0], **args[1])
        assert e.value.code == code
    with pytest.raises(CollectionError) as e:
        c.update(path, {"points": 2}, if_revision="sha256:0")
    assert e.value.code == "concurrent_modification"
    c.update(path, {"points": 2}, unset=["code"], body="new", if_revision=made["revision"])
    again = c.read(path)
    assert again["frontmatter"]["points"] == 2 and "code" not in again["frontmatter"] and again["body"] == "new"
    assert c.delete("tasks/one.md") == [("tasks/one.md", "[[tasks/two.md]]")]
    with pytest.raises(CollectionError):
        c.read("tasks/one.md")


def test_rename_and_batches(c):
    assert c.rename("tasks/one.md", "tasks/uno.md") == ["tasks/two.md"]
    assert c.read("tasks/two.md")["body"] == "See [[uno]]\n"
    assert c.batch_update({"status": "done"}, {"points": {"lt": 4}}, dry_run=True) == ["tasks/uno.md"]
    c.batch_update({"status": "done"}, "points < 4")
    assert c.read("tasks/uno.md")["frontmatter"]["status"] == "done"
    with pytest.raises(CollectionError):
        c.batch_update({"status": "nope"}, "points > 0")
    assert c.read("tasks/two.md")["frontmatter"]["status"] == "done"
    assert c.batch_delete("points == 5") == ["tasks/two.md"] and not c.files.exists("tasks/two.md")


def test_validate(c):
    c.files.write("tasks/bad.md", b"---\ntype: task\ntitle: Bad\npoints: x\nstatus: maybe\n---\n")
    assert {(r["path"], r["code"]) for r in c.validate().collect()} == {("tasks/bad.md", "type_mismatch"), ("tasks/bad.md", "invalid_enum")}


def test_newer_profile(spark, tmp_path):
    (tmp_path / "_types").mkdir()
    (tmp_path / "any.yml").write_text('spec_version: "0.3.0"\n')
    (tmp_path / "_types/note.md").write_text("""---
name: note
schema: {type: object, required: [title], properties: {title: {type: string, minLength: 2}, at: {type: string, format: date-time}}}
match: {path_glob: "n/**"}
collection: {read_defaults: {kind: plain}, unique: [{field: title, scope: type}]}
lifecycle: {on_create: [{set: {slug: {slugify: title}}}, {if: 'title == "Hello"', set: {made: {literal: true}}}], on_update: {set: {n: {copy: title}}}}
---
""")
    c = Collection.open(spark, str(tmp_path))
    assert c.create({"title": "Hello"}, type="note", path="n/a.md") == "n/a.md"
    got = c.read("n/a.md")["frontmatter"]
    assert got["slug"] == "hello" and got["made"] is True and got["kind"] == "plain"
    with pytest.raises(CollectionError) as e:
        c.create({"title": "Hello"}, type="note", path="n/b.md")
    assert e.value.code == "validation_failed"
    with pytest.raises(CollectionError):
        c.create({"title": "x"}, type="note", path="n/b.md")
    c.update("n/a.md", {"title": "Other"})
    assert c.read("n/a.md")["frontmatter"]["n"] == "Other"
    assert c.query({"where": 'kind == "plain" && !has(raw.kind)'}).rows.count() == 1
    c.create_type("extra", {"fields": {"x": {"type": "string"}}})
    assert "extra" in Collection.open(spark, str(tmp_path)).types


@pytest.mark.parametrize("text", ["- 1", "spec_version: 3", 'spec_version: "0.2.0"\nsettings: {exclude: x}', 'spec_version: "0.2.0"\nsettings: {types_folder: "../x"}', 'spec_version: "0.3.0"\nsettings: {timezone: Nowhere/City}', 'spec_version: "0.2.0"\nsettings: {validation: loud}'])
def test_bad_configs(text):
    with pytest.raises(ConfigError):
        parse_config(text)


def test_bad_types():
    for text in ("no frontmatter", "---\nfields: {a: {type: blob}}\n---\n", "---\nfields: {a: {type: enum}}\n---\n", "---\nmatch: {expr: {$expr: '1 +'}}\n---\n", "---\nschema: {pattern: '('}\n---\n"):
        with pytest.raises(ConfigError):
            parse_type(text, "t.md")
    a, b = parse_type("---\nname: a\nextends: b\n---\n", "a.md"), parse_type("---\nname: b\nextends: a\n---\n", "b.md")
    with pytest.raises(ConfigError) as e:
        inherit({"a": a, "b": b})
    assert e.value.code == "circular_inheritance"
    with pytest.raises(ConfigError) as e:
        inherit({"a": a})
    assert e.value.code == "missing_parent_type"


def test_field_references():
    v = {"a": {"b": [{"c": 1}, {"c": 2}, {}]}, "x/y": 5}
    assert field_refs.get(v, "a.b[].c") == [1, 2] and field_refs.get(v, "/a/b/1/c") == 2 and field_refs.get(v, "/x~1y") == 5 and field_refs.get(v, "a.z") is field_refs.MISSING
    field_refs.put(v, "a.b[].c", 9)
    field_refs.put(v, "new.deep", 1)
    assert v["a"]["b"] == [{"c": 9}] * 3 and v["new"] == {"deep": 1}
    assert field_refs.remove(v, "a.b[].c") and v["a"]["b"] == [{}, {}, {}] and not field_refs.remove(v, "a.q")
    with pytest.raises(ValueError):
        field_refs.put({"a": 1}, "a.b", 2)


def test_observability():
    seen = []

    @observability.traced
    def outer(fail=False):
        inner()
        if fail:
            raise CollectionError("broken", "x")

    @observability.traced
    def inner():
        return 1

    observability.listen(seen.append)
    try:
        outer()
        with pytest.raises(CollectionError):
            outer(fail=True)
        observability.listen(lambda e: 1 / 0)
        outer()
        observability.listen(seen.append, least_seconds=60)
        outer()
    finally:
        observability.listen(None)
    assert [(e.operation, e.failed, e.error) for e in seen] == [("outer", False, None), ("outer", True, "broken")]


def test_stored_texts_are_read_as_declared(spark, tmp_path):
    files = {
        "collection.yaml": 'spec_version: "0.2.0"\n',
        "_types/item.md": "---\nname: item\nmatch: {path_glob: 'items/*.md'}\nfields:\n  count: {type: integer}\n  rate: {type: number}\n  on: {type: boolean}\n  label: {type: string}\n  twice: {type: number, computed: 'count * 2'}\n---\n",
        "items/a.md": "---\ncount: '12'\nrate: '2.5'\n'on': 'Yes'\nlabel: 7\n---\n", "items/b.md": "---\ncount: 3.0\nrate: fast\n'on': maybe\nlabel: true\n---\n", "other.md": "---\ncount: '5'\n---\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    c = Collection.open(spark, str(tmp_path))
    a, b = c.read("items/a.md"), c.read("items/b.md")
    assert a["frontmatter"] == {"count": 12, "rate": 2.5, "on": True, "label": "7", "twice": 24} and a["raw"]["count"] == "12"
    assert b["frontmatter"] == {"count": 3, "rate": "fast", "on": "maybe", "label": "true", "twice": 6}
    assert c.read("other.md")["frontmatter"] == {"count": "5"}
    assert [r["path"] for r in c.query({"types": ["item"], "where": "count > 4"}).rows.collect()] == ["items/a.md"]


def held(c, *paths):
    return {p: c.files.read(p) if c.files.exists(p) else None for p in paths}


def test_batches_of_operations(c):
    paths = ("tasks/one.md", "tasks/two.md", "tasks/new.md", "alpha.md", "beta.md")
    before = held(c, *paths)
    steps = [
        {"op": "create", "path": "tasks/new.md", "fields": {"title": "new", "points": 1}, "type": "task"},
        {"op": "update", "path": "tasks/new.md", "fields": {"points": 2}},
        {"op": "rename", "old": "alpha.md", "new": "beta.md"},
        {"op": "delete", "path": "tasks/two.md"},
    ]
    got = c.batch(steps, dry_run=True)
    assert all(x["ok"] for x in got) and held(c, *paths) == before
    bad = [*steps[:3], {"op": "update", "path": "tasks/one.md", "fields": {"points": -4}}, steps[3]]
    with pytest.raises(CollectionError) as e:
        c.batch(bad)
    assert e.value.code == "batch_failed" and e.value.details["code"] == "validation_failed" and held(c, *paths) == before
    got = c.batch([{"op": "update", "path": "gone.md", "fields": {"x": 1}}, {"op": "create", "path": "gone.md", "fields": {}}, *bad], allow_partial=True)
    assert [x["ok"] for x in got] == [False, False, True, True, True, False, True] and [x.get("code") for x in got[:2]] == ["file_not_found", "batch_failed"]
    assert c.read("tasks/new.md")["frontmatter"]["points"] == 2 and not c.files.exists("tasks/two.md") and not c.files.exists("alpha.md")
    assert "beta" in c.read("tasks/one.md")["raw"]["project"]
    with pytest.raises(CollectionError) as e:
        c.batch([{"op": "dance"}])
    assert e.value.code == "unknown_operation"
    done = c.update_many([{"path": "tasks/one.md", "fields": {"points": 9}}, {"path": "tasks/new.md", "fields": {"points": -1}}], allow_partial=True)
    assert [x["ok"] for x in done] == [True, False] and c.read("tasks/one.md")["frontmatter"]["points"] == 9
    assert c.files.folders(".journal") == []


def test_an_unfinished_batch_is_taken_back_on_opening(c, spark):
    before = held(c, "tasks/one.md", "tasks/late.md")
    from fernglass.journal import Journal

    c.files.journal = Journal(c.files)  # and then the process ends
    c.files.write("tasks/one.md", b"half")
    c.files.write("tasks/late.md", b"made")
    c.files.delete("alpha.md")
    again = Collection.open(spark, c.root)
    assert held(again, "tasks/one.md", "tasks/late.md") == before and again.files.exists("alpha.md") and again.files.folders(".journal") == []


def test_file_names_are_checked(c):
    c.files.write("tasks/odd.md", b"---\ntype: task\ntitle: Even\npoints: 1\n---\n")
    c.refresh()
    found = [(r["path"], r["severity"]) for r in c.validate("records").where("code = 'filename_mismatch'").collect()]
    assert ("tasks/odd.md", "warning") in found and c.validate().where("code = 'filename_mismatch'").isEmpty()


def test_every_code_is_in_the_catalogue():
    import re
    from pathlib import Path

    import fernglass
    from fernglass import errors

    used = set()
    for f in Path(fernglass.__file__).parent.rglob("*.py"):
        used |= set(re.findall(r'(?:CollectionError|ConfigError|ExpressionError|MigrationError)\((?:f?"[^"]*", )?"([a-z]+(?:_[a-z]+)+)"', f.read_text()))
    assert used - errors.ALL == set() and errors.about("path_conflict") == "files" and errors.about("own_code") is None
