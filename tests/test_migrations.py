import pytest

from fernglass.collection import Collection
from fernglass.sources import migrations as M
from fernglass.sources.config import parse_type
from tests.test_collection import FILES


@pytest.fixture
def c(spark, tmp_path):
    for name, text in FILES.items():
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return Collection.open(spark, str(tmp_path))


def test_field_schemas():
    d = {"type": "list", "min": 1, "unique": True, "items": {"type": "object", "fields": {"to": {"type": "link", "required": True}, "n": {"type": "integer", "max": 3}}}}
    assert M.field_schema(d) == {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"type": "object", "additionalProperties": False, "required": ["to"], "properties": {"to": {"type": "string"}, "n": {"type": "integer", "maximum": 3}}}}
    assert M.link_rules("refs", d) == {"refs[].to": {"target_type": "any", "validate_exists": False}}


def test_newer_type():
    t = parse_type('---\nname: t\nstrict: true\npath_pattern: "{id}"\nmatch: {path_glob: "x/**"}\nfields:\n  id: {type: string, generated: ulid, unique: true, required: true}\n  at: {type: datetime, generated: now_on_write}\n  s: {type: enum, values: [a, b], default: a}\n  slug: {type: string, generated: {from: id, transform: slugify}}\n  n: {type: integer, generated: sequence}\n---\n', "t.md")
    made, notes = M.newer_type(t)
    assert made["schema"]["required"] == ["id"] and made["schema"]["additionalProperties"] is False and made["collection"]["read_defaults"] == {"s": "a"}
    assert made["lifecycle"] == {"on_create": {"set": {"id": {"ulid": True}, "at": {"now": True}, "slug": {"slugify": "id"}}}, "on_update": {"set": {"at": {"now": True}}}}
    assert len(notes) == 1 and parse_type(M.document(made), "t.md").schema == made["schema"]


def test_migrate_and_manifest(c, spark):
    assert set(M.migrate_types(c)) == {"task", "sub"} and not c.config.strict_profile
    done = M.run_manifest(c, {"steps": [{"action": "backfill", "type": "task", "field": "status", "value": "open"}, {"action": "add_field", "type": "task", "field": "x"}]})
    assert done[0]["changed"] == ["tasks/one.md"] and done[1]["manual"] and c.read("tasks/one.md")["raw"]["status"] == "open"
    M.migrate_types(c, dry_run=False)
    again = Collection.open(spark, c.root)
    assert again.config.strict_profile and again.types["task"].schema["properties"]["points"] == {"type": "integer", "minimum": 0}


def test_merge():
    assert M.merge({"a": 1, "b": 1}, {"a": 2, "b": 1}, {"a": 1, "b": 3, "c": 4}) == {"a": 2, "b": 3, "c": 4}
    assert M.merge({"a": 1}, {"a": 1}, {}) == {}
    with pytest.raises(M.MergeConflict):
        M.merge({"a": 1}, {"a": 2}, {"a": 3})


def test_packs(c):
    one = "---\nname: extra\nfields: {x: {type: string}}\n---\n"
    pack = {"id": "p", "version": "1", "resources": [{"target": "_types/extra.md", "document": one, "mode": "seed"}, {"target": "docs/readme.md", "document": "v1"}]}
    plan = M.assess(c, pack)
    assert plan["status"] == "install" and {r["action"] for r in plan["resources"]} == {"create"}
    with pytest.raises(M.MergeConflict):
        M.install(c, pack, expected="sha256:0")
    M.install(c, pack, expected=plan["digest"])
    assert M.assess(c, pack)["status"] == "current"
    c.files.write("_types/extra.md", one.replace("}}", "}, mine: {type: number}}").encode())
    two = {**pack, "version": "2", "resources": [{"target": "_types/extra.md", "document": one.replace("name: extra", "name: extra\nstrict: warn"), "mode": "seed", "baselines": [one]}, {"target": "docs/readme.md", "document": "v2"}]}
    M.install(c, two)
    merged = parse_type(c.files.read("_types/extra.md").decode(), "extra.md")
    assert merged.strict == "warn" and set(merged.fields) == {"x", "mine"} and c.files.read("docs/readme.md") == b"v2"
    c.files.write("docs/readme.md", b"changed by hand")
    assert M.assess(c, {**two, "resources": [{"target": "docs/readme.md", "document": "v3"}]})["status"] == "conflict"
    bad = {"id": "q", "version": "1", "resources": [{"target": "a/new.md", "document": "x"}, {"target": "_types/bad.md", "document": "no type"}]}
    with pytest.raises(ValueError):
        M.install(c, bad)
    assert not c.files.exists("a/new.md")
