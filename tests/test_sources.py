import random

import pytest
from pyspark.sql import functions as F

from fernglass.operators import links as L
from fernglass.records import META, Records
from fernglass.sources import markdown as M
from fernglass.sources.snapshot import Conflict, SnapshotStore
from fernglass.streaming.changefeed import follow
from tests.helpers import collection, native


def test_scan_leaves_out_what_isnt_a_record(spark, tmp_path):
    files = {p: "x" for p in ("a.md", "sub/b.md", "sub/deep/c.md", ".hidden/d.md", "node_modules/e.md", "_types/t.md", "drafts/f.md", "img.png", "other/collection.yaml", "other/g.md", "other/in/h.md", "collection.yaml", "with space+plus.md")}
    scan = M.Scan(exclude=("drafts",))
    r = collection(spark, tmp_path, files, scan)
    assert sorted(x["path"] for x in r.df.collect()) == ["a.md", "sub/b.md", "sub/deep/c.md", "with space+plus.md"]
    flat = M.read_markdown(spark, str(tmp_path), M.Scan(include_subfolders=False))
    assert sorted(x["path"] for x in flat.df.collect()) == ["a.md", "with space+plus.md"]
    assert [x["path"] for x in r.assets.collect()] == ["img.png"]


@pytest.mark.parametrize("text, fields, body, error", [
    ("---\na: 1\n---\nbody\n", '{"a": 1}', "body\n", None), ("no frontmatter", "{}", "no frontmatter", None), ("\n---\na: 1\n---\n", "{}", "\n---\na: 1\n---\n", None), ("---\n---\nb", "{}", "b", None),
    ("---\n- 1\n---\nb", "{}", "b", "non_mapping"), ("---\n~\n---\n", "{}", "", "non_mapping"), ("---\na: [\n---\n", "{}", "", "invalid_frontmatter"), ("---\na: 1\n", "{}", "---\na: 1\n", None),
    ("---\nd: 2024-01-01\nb: yes\nt: true\no: 010\ne: 1e3\nn: null\n---\n", '{"d": "2024-01-01", "b": "yes", "t": true, "o": 10, "e": 1000.0, "n": null}', "", None),
])
def test_parse(text, fields, body, error):
    got = M.parse_record(text.encode())
    assert got[:3] == (fields, body, error)


def test_parse_invalid_utf8_and_documents():
    assert M.parse_record(b"---\na: \xff\n---\n")[2] == "invalid_frontmatter"
    assert M.parse_record(b"a: 1\nb: [x]\n", whole_document=True)[:2] == ('{"a": 1, "b": ["x"]}', "")


def test_write_and_read_back(spark, tmp_path):
    text = {"a.md": '---\ntitle: "yes: no"\nn: 5\nlist: [1, two, null]\nwhen: "2024-01-01"\nflag: "true"\nmulti: |\n  a\n  b\n---\nBody ---\n', "s/b.md": "only body"}
    r = collection(spark, tmp_path / "in", text)
    assert M.write_markdown(r, str(tmp_path / "out")) == 2
    again = M.read_markdown(spark, str(tmp_path / "out"))
    show = lambda x: {p: (native(f), b) for p, f, b in x.df.select("path", "raw", "body").collect()}
    assert show(r) == show(again) and show(r)["a.md"][0]["flag"] == "true"
    assert not [p for p in (tmp_path / "out").rglob(".*")]


def test_revision_and_errors(spark, tmp_path):
    import hashlib

    r = collection(spark, tmp_path, {"a.md": "x", "bad.md": "---\na: [\n---\n", "list.md": "---\n- 1\n---\n"})
    assert {x["path"]: x["revision"] for x in r.df.collect()}["a.md"] == "sha256:" + hashlib.sha256(b"x").hexdigest()
    assert sorted(x["path"] for x in M.read_errors(spark, str(tmp_path)).collect()) == ["bad.md", "list.md"]
    assert sorted(x["path"] for x in r.df.collect()) == ["a.md", "list.md"]


def test_snapshot_store(spark, tmp_path):
    root = tmp_path / "files"
    r = collection(spark, root, {"a.md": "---\nn: 1\n---\n", "b.md": "b"})
    store = SnapshotStore(spark, str(tmp_path / "store"))
    assert store.version() == 0 and store.commit(r) == 1
    with pytest.raises(Conflict):
        store.commit(r, based_on=0)
    (root / "c.md").write_text("new")
    (root / "b.md").unlink()
    fresh = store.refresh(str(root))
    assert sorted(x["path"] for x in fresh.collect()) == ["a.md", "c.md"]
    assert store.commit(fresh, based_on=1) == 2 and store.read(1).df.count() == 2
    store.clear()
    assert store.version() == 0


def test_incremental_equals_rebuild(spark, tmp_path):
    """A scripted sequence of changes: the refreshed snapshot is what a cold read gives, links included."""
    rng, root, store = random.Random(5), tmp_path / "files", SnapshotStore(spark, str(tmp_path / "store"))
    collection(spark, root, {f"items/{i}.md": f"---\nn: {i}\n---\n[[{i - 1}]]\n" for i in range(8)})
    for step in range(4):
        for _ in range(4):
            i = rng.randrange(12)
            at = root / "items" / f"{i}.md"
            if rng.random() < 0.3 and at.exists():
                at.unlink()
            else:
                at.write_text(f"---\nn: {step}\n---\n[[{rng.randrange(12)}]] {'x' * step}\n")
        store.commit(store.refresh(str(root)))
    warm, cold = store.read(parse_body=True), M.read_markdown(spark, str(root))
    rows = lambda r: sorted((x["path"], str(x["raw"]), x["body"]) for x in r.df.collect())
    links = lambda r: sorted(map(tuple, L.edges(r).collect()))
    assert rows(warm) == rows(cold) and links(warm) == links(cold)


def test_change_feed(spark, tmp_path):
    none = lambda k: F.lit(None).cast(k)

    def batch(n, rows):
        df = spark.createDataFrame(rows, "path string, body string, deleted boolean")
        fields = F.parse_json(F.lit("{}"))
        out = df.select("path", F.array().cast("array<string>").alias("types"), "body", fields.alias("fields"), fields.alias("raw"), F.timestamp_seconds(F.lit(n)).alias("mtime"), none("timestamp").alias("ctime"), none("bigint").alias("size"), none("string").alias("revision"), "deleted")
        out.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return out.schema

    schema = batch(1, [("a.md", "1", False), ("b.md", "1", False)])
    store, seen = SnapshotStore(spark, str(tmp_path / "store")), []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = follow(stream, store, lambda c, i: seen.append((i, sorted((x["event"], x["path"]) for x in c.collect()))), str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
        batch(2, [("a.md", "2", False), ("b.md", "1", True), ("c.md", "9", False)])
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen == [(0, [("file_created", "a.md"), ("file_created", "b.md")]), (1, [("file_created", "c.md"), ("file_deleted", "b.md"), ("file_modified", "a.md")])]
    assert sorted(x["path"] for x in store.read().df.collect()) == ["a.md", "c.md"]
    assert set(META) <= set(Records(store.read().df).df.columns)


def test_change_feed_goes_on_after_a_restart(spark, tmp_path):
    """Stopped and started again the feed applies nothing twice; a batch stored but not told is told again."""
    from pyspark.sql import functions as F

    from fernglass.records import META

    base = collection(spark, tmp_path / "c", {"a.md": "---\nx: 1\n---\n", "b.md": "---\nx: 2\n---\n", "d.md": "---\nx: 4\n---\n"}).df.select(*META)
    rows = base.withColumn("fields", F.to_json("fields")).withColumn("raw", F.to_json("raw")).withColumn("deleted", F.lit(False))
    feed, seen = tmp_path / "feed", []
    store = SnapshotStore(spark, str(tmp_path / "store"))

    def start(on=lambda c, i: seen.append((i, sorted((x["event"], x["path"]) for x in c.collect())))):
        stream = spark.readStream.schema(rows.schema).parquet(str(feed)).withColumn("fields", F.parse_json("fields")).withColumn("raw", F.parse_json("raw"))
        q = follow(stream, store, on, str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()

    rows.where("path = 'a.md'").write.mode("append").parquet(str(feed))
    start()
    rows.where("path = 'b.md'").write.mode("append").parquet(str(feed))
    start()
    assert seen == [(0, [("file_created", "a.md")]), (1, [("file_created", "b.md")])] and store.version() == 2
    rows.where("path = 'd.md'").write.mode("append").parquet(str(feed))

    def fails(changes, i):
        raise RuntimeError("lost")

    import contextlib

    with contextlib.suppress(Exception):
        start(fails)
    assert store.version() == 3  # stored, not told
    start()
    assert seen[2:] == [(2, [("file_created", "d.md")])] and store.version() == 3
