import pytest
from pyspark.sql import functions as F

from fernglass import function_queries, queries
from fernglass.operators.membership import TypeRule, with_defaults, with_types
from fernglass.plans.query import QueryError, execute, validate
from fernglass.plans.views import Views
from fernglass.records import from_table
from tests.helpers import collection, native, variant_records


@pytest.fixture(scope="module")
def tasks(spark):
    rows = {
        "tasks/b.md": {"title": "B", "status": "open", "priority": 3, "tags": ["#x/y"]},
        "tasks/a.md": {"title": "A", "status": "done", "priority": 1.5},
        "tasks/c.md": {"title": "C", "priority": "high"},
        "tasks/d.md": {"title": "D", "status": None, "priority": 10, "tags": "z"},
        "notes/n.md": {"title": "N"},
    }
    return variant_records(spark, rows, types={p: ["task"] if p.startswith("tasks") else ["note"] for p in rows}, bodies={"tasks/b.md": "see #body/tag and `#code`"})


def paths(result):
    return [r["path"] for r in result.rows.collect()]


def test_where_drops_errors_and_warns(tasks):
    q = execute(tasks, {"where": "priority >= 3"})
    assert paths(q) == ["tasks/b.md", "tasks/d.md"]  # a text isn't comparable, a missing field neither
    assert {(d["path"], d["field"]) for d in q.diagnostics().collect()} == {("tasks/c.md", "where"), ("notes/n.md", "where")}


def test_default_order_is_by_collated_path(spark):
    r = variant_records(spark, {p: {} for p in ("b.md", "A.md", "_z.md", "a.md", "10.md", "2.md")})
    assert paths(execute(r, {})) == ["_z.md", "10.md", "2.md", "a.md", "A.md", "b.md"]


def test_types_select_and_projections(tasks):
    q = execute(tasks, {
        "types": ["TASK"], "projections": {"twice": {"expr": "projection.base * 2.0"}, "base": {"expr": "double(priority)"}},
        "select": ["title", {"name": "t", "expr": "projection.twice"}], "order_by": [{"field": "t", "direction": "desc"}],
    })
    assert [(native(r["title"]), r["t"]) for r in q.values.collect()] == [("C", None), ("D", 20.0), ("B", 6.0), ("A", 3.0)]


def test_presence_and_null(spark):
    r = variant_records(spark, {"a.md": {"status": None}, "b.md": {"status": "x"}, "c.md": {}})
    assert paths(execute(r, {"where": "has(raw.status)"})) == ["a.md", "b.md"]
    assert paths(execute(r, {"where": "status == null"})) == ["a.md", "c.md"]
    assert paths(execute(r, {"where": "record.status == null"})) == ["a.md"]  # selecting a key that isn't there is an error
    assert paths(execute(r, {"where": '!has(raw.status) && missing == null'})) == ["c.md"]


def test_tags_and_folders(tasks):
    assert paths(execute(tasks, {"where": 'file.hasTag("x")'})) == ["tasks/b.md"]
    assert paths(execute(tasks, {"where": 'file.hasTag("#body")'})) == ["tasks/b.md"]
    assert paths(execute(tasks, {"where": 'file.inFolder("/notes/")'})) == ["notes/n.md"]
    assert [r["tags"] for r in execute(tasks, {"select": [{"name": "tags", "expr": "file.tags"}], "where": 'file.name == "b.md"'}).values.collect()] == [["x/y", "body/tag"]]


def test_groups_and_summaries(tasks):
    q = execute(tasks, {
        "group_by": [{"field": "status"}], "types": ["task"], "limit": 1,
        "summaries": [{"field": "priority", "function": f, "name": f} for f in ("count", "filled", "empty", "sum", "average", "minimum", "maximum")],
    })
    rows = q.groups.collect()
    assert [r["status"] for r in rows] == ['"done"', '"open"', None]
    assert (rows[0]["sum"], rows[1]["average"], rows[2]["sum"]) == (1.5, 3.0, None)  # a text makes the sum null
    assert [r["count"] for r in rows] == [1, 1, 2] and rows[2]["filled"] == 2
    assert q.meta().first()["total_count"] == 4 and q.meta().first()["has_more"]


def test_global_group_of_nothing(tasks):
    q = execute(tasks, {"where": "false", "summaries": [{"field": "priority", "function": "count"}, {"field": "priority", "function": "sum"}]})
    assert [tuple(r) for r in q.groups.collect()] == [(0, 0, None)]
    assert execute(tasks, {"where": "false", "group_by": [{"field": "status"}]}).groups.count() == 0


def test_order_places_nulls(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 1.0)], "id long, x double")
    r = from_table(df, F.concat(F.lit("t/"), "id"))
    ids = lambda **o: [x["id"] for x in execute(r, {"select": ["id"], "order_by": [{"field": "x", **o}]}).values.collect()]
    assert ids() == [3, 1, 2] and ids(direction="desc") == [2, 1, 3]


def test_page(spark):
    r = variant_records(spark, {f"{i}.md": {} for i in range(5)})
    assert paths(execute(r, {"offset": 1, "limit": 2})) == ["1.md", "2.md"]
    assert paths(execute(r, {"limit": 0})) == []
    assert not execute(r, {"offset": 3, "limit": 2}).meta().first()["has_more"]
    assert execute(r, {"offset": 2, "limit": 2}).meta().first()["has_more"]


@pytest.mark.parametrize("query, code", [
    ({"where": "1 +"}, "invalid_query"), ({"limit": -1}, "invalid_query"), ({"select": ["a.x", "b.x"]}, "invalid_query"), ({"timezone": "+10:00"}, "invalid_timezone"),
    ({"timezone": "local"}, "invalid_timezone"), ({"projections": {"a": {"expr": "projection.b"}, "b": {"expr": "projection.a"}}}, "invalid_query"), ({"nope": 1}, "invalid_query"),
    ({"summaries": [{"field": "a", "function": "sum"}, {"field": "b", "function": "sum"}]}, "invalid_query"), ({"context": {"this": {"path": "zz"}}}, "context_not_found"),
    ({"order_by": [{"field": "a", "direction": "up"}]}, "invalid_query"), ({"where": "frobnicate(1)"}, "unknown_function"), ({"frontmatter_mode": "x"}, "invalid_query"),
])
def test_bad_queries(tasks, query, code):
    with pytest.raises(QueryError) as e:
        execute(tasks, query)
    assert e.value.code == code


def test_a_day_depends_on_the_zone(spark):
    r = variant_records(spark, {"log.md": {"seen": "2019-12-31T14:45:00Z"}, "none.md": {}}, instants=("seen",))
    at = lambda z: [x[0] for x in execute(r, {"timezone": z, "select": [{"name": "d", "expr": "date(seen)"}], "order_by": [{"field": "file.path"}]}).values.collect()]
    assert [at(z) for z in ("Asia/Tokyo", "UTC", "Pacific/Honolulu", "Asia/Kolkata")] == [["2019-12-31", None], ["2019-12-31", None], ["2019-12-31", None], ["2019-12-31", None]]
    late = variant_records(spark, {"log.md": {"seen": "2019-12-31T15:00:00Z"}}, instants=("seen",))
    assert [execute(late, {"timezone": z, "select": [{"name": "d", "expr": "date(seen)"}]}).values.first()[0] for z in ("Asia/Tokyo", "Asia/Kolkata")] == ["2020-01-01", "2019-12-31"]


def test_links_are_relative_to_where_they_stand(spark, tmp_path):
    r = collection(spark, tmp_path, {
        "library/shelf/moby.md": "---\nauthor: '[[../writers/melville]]'\nsequels: ['[[./omoo]]', '[[./typee]]']\n---\nRead with [typee](typee.md), ![[cover.png]] and [[library/shelf/omoo|the other]].\n",
        "library/shelf/omoo.md": "---\nyear: 1847\n---\n", "library/shelf/typee.md": "---\nyear: 1846\n---\n",
        "library/writers/melville.md": "---\nborn: 1819\nfirst: '[its](../shelf/typee.md)'\n---\n",
        "loans/march.md": "---\nbook: '[[moby]]'\n---\n",
    })
    one = lambda expr, path="loans/march.md": native(execute(r, {"where": f'file.path == "{path}"', "select": [{"name": "x", "expr": expr}]}).values.first()[0])
    assert one("book.asFile().author.asFile().born") == 1819
    assert one("book.asFile().author.asFile().first.asFile().year") == 1846
    assert one("book.asFile().sequels.map(s, s.asFile().file.name)") == ["omoo.md", "typee.md"]
    moby = "library/shelf/moby.md"
    assert one("size(file.links)", moby) == 5 and one("file.embeds", moby) == ["[[cover.png]]"]
    assert one("file.links.exists(l, l.asFile().year == 1846)", moby) is True and one("file.links.all(l, l.asFile().year == 1846)", moby) is not True
    assert one('file.hasLink("[[omoo]]") && !file.hasLink("[[march]]")', moby) is True
    q = execute(r, {"context": {"this": {"path": moby}}, "where": 'has(record.year) && int(year) > 1846 && this.sequels.exists(s, s.asFile().file.path == file.path)', "select": ["year", {"name": "born", "expr": "this.author.asFile().born"}]})
    assert [(native(x["year"]), native(x["born"])) for x in q.values.collect()] == [(1847, 1819)]
    back = execute(r, {"where": "file.backlinks.size() > 0", "select": [{"name": "n", "expr": "file.backlinks.size()"}]}, ordered=False)
    assert {x["path"]: x["n"] for x in back.rows.collect()} == {moby: 1, "library/shelf/omoo.md": 1, "library/shelf/typee.md": 1, "library/writers/melville.md": 1}


def test_filters_see_defaults_and_bodies(spark, tmp_path):
    r = collection(spark, tmp_path, {"crew/ann.md": "---\nrole: cook\n---\nSails on the night watch.\n", "crew/deep/ned.md": "---\nship: Argo\n---\n", "harbour.md": "night watch"})
    r = with_defaults(with_types(r, [TypeRule("sailor", path_glob=("crew/**/*.md",))]), {"ship": "Beagle"})
    assert paths(execute(r, {"types": ["sailor"], "where": 'ship == "Beagle"'})) == ["crew/ann.md"]
    assert paths(execute(r, {"where": 'file.body.contains("night watch") && !file.inFolder("crew")'})) == ["harbour.md"]
    assert "body" not in execute(r, {}).rows.columns and "body" in execute(r, {"include_body": True}).rows.columns


def test_the_same_link_is_joined_once(spark, tmp_path):
    r = collection(spark, tmp_path, {"a.md": "---\nto: '[[b]]'\n---\n", "b.md": "---\nx: 1\ny: 2\n---\n"})
    q = execute(r, {"where": 'file.path == "a.md"', "select": [{"name": n, "expr": f"to.asFile().{n}"} for n in "xy"]}, ordered=False)
    assert sum(c.startswith("__site") for c in q.matched.columns) == 1
    assert [tuple(map(native, x)) for x in q.values.collect()] == [(1, 2)]


def test_membership(spark):
    rows = {"a.md": {"types": ["One", "Two"], "type": "three"}, "b.md": {"type": "Solo"}, "c.md": {"assignee": None}, "d.md": {"assignee": "x", "n": 5}}
    rules = [TypeRule("has", where={"assignee": {"exists": True}}), TypeRule("set", fields_present=("assignee",)), TypeRule("five", expr="n == 5"), TypeRule("bad", expr="1 / 0 > 0")]
    got = {r["path"]: r["types"] for r in with_types(variant_records(spark, rows), rules).df.select("path", "types").collect()}
    assert got == {"a.md": ["one", "two"], "b.md": ["solo"], "c.md": ["has"], "d.md": ["has", "set", "five"]}


def test_views(tasks):
    views = Views({"views/v.md": {
        "id": "v", "query": {"types": ["task"], "where": "priority > 1", "projections": {"p": {"expr": "priority"}}},
        "views": [{"id": "all"}, {"id": "open", "where": 'status == "open"', "context": {"this": {"on_missing": "null"}}}, {"id": "strict", "context": {"this": {"on_missing": "error"}}}, {"id": "clash", "projections": {"p": {"expr": "1"}}}],
    }})
    assert paths(views.execute(tasks, "v", "open")) == ["tasks/b.md"]
    assert views.list()[0]["views"][0]["id"] == "all"
    for args, code in ((("v", "nope"), "view_not_found"), (("w", "all"), "view_not_found"), (("v", "strict"), "context_required"), (("v", "clash"), "invalid_view"), (("v", "all"), "context_not_found")):
        with pytest.raises(QueryError) as e:
            views.execute(tasks, *args)
        assert e.value.code == code
    with pytest.raises(QueryError) as e:
        views.execute(tasks, "v", "open", render=True)
    assert e.value.code == "unsupported_presentation"
    with pytest.raises(QueryError) as e:
        views.execute(tasks, "v", "all", context={"path": "gone.md"})
    assert e.value.code == "context_not_found"


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id * 2 as double) as x", "cast(id as string) as s").write.parquet(str(tmp_path / "t"))
    r = from_table(spark.read.parquet(str(tmp_path / "t")), F.concat(F.lit("t/"), "id"))
    q = execute(r, {"where": 'x >= 50.0 && s != "30"', "select": ["id"], "order_by": [{"field": "id"}], "limit": 5})
    plan = q.values._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,50.0)" in plan and "TakeOrderedAndProject" in plan


def test_validate_accepts_extensions():
    assert validate({"x-note": 1, "where": "true"}) == []


def whole_windows(df) -> int:
    """How many windows over everything a plan has that see more than one row per group."""
    def inner(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from inner(plan.children().apply(i))

    nodes = inner(df._jdf.queryExecution().optimizedPlan())
    return sum(n.nodeName() == "Window" and not any(x.nodeName() == "Aggregate" for x in inner(n)) for n in nodes)


def small_orders(spark, root, parts: int = 7) -> str:
    """Orders in several files; a status that is null, and one that most rows share."""
    df = spark.range(0, 400, 1, parts).select(
        F.col("id").alias("o_orderkey"), F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 9 == 0, "P").otherwise("O").alias("o_orderstatus"),
        ((F.col("id") * 7919) % 300 * 1000.0).alias("o_totalprice"), F.element_at(F.array(*map(F.lit, ["2-HIGH", "5-LOW", "none"])), (F.col("id") % 3 + 1).cast("int")).alias("o_orderpriority"),
    )
    df.write.parquet(f"{root}/orders.parquet")
    return str(root)


def test_rows_of_groups_are_numbered_without_a_window_over_them(spark, tmp_path):
    got = function_queries.legacy_group_rows(spark, d := small_orders(spark, tmp_path))
    assert whole_windows(got) == 0
    rows = [r.asDict() for r in spark.read.parquet(f"{d}/orders.parquet").collect()]
    want, groups = [], [None, "P", "O"]  # descending, null first
    for g, key in enumerate(groups, 1):
        inside = sorted((r for r in rows if r["o_orderstatus"] == key), key=lambda r: (r["o_totalprice"], r["o_orderkey"]))
        want += [(key, r["o_orderkey"], g, n) for n, r in enumerate(inside, 1)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())


def test_rows_by_a_nullable_value_are_numbered_without_a_window_over_them(spark, tmp_path):
    got = queries.order_nulls(spark, d := small_orders(spark, tmp_path))
    assert whole_windows(got) == 0
    big = {r["o_orderkey"]: r["o_totalprice"] if r["o_totalprice"] > 150000 else None for r in spark.read.parquet(f"{d}/orders.parquet").collect()}
    want = sorted(big, key=lambda k: (big[k] is not None, -(big[k] or 0), k))
    assert [r["o_orderkey"] for r in sorted(got.collect(), key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in got.collect()) == list(range(1, len(want) + 1))


def test_rows_by_an_enum_are_numbered_without_a_window_over_them(spark, tmp_path):
    got = queries.order_enum(spark, d := small_orders(spark, tmp_path))
    assert whole_windows(got) == 0
    place = {r["o_orderkey"]: [*queries.PRIORITIES, "none"].index(r["o_orderpriority"]) for r in spark.read.parquet(f"{d}/orders.parquet").collect()}
    assert [(r["place"], r["o_orderkey"]) for r in sorted(got.collect(), key=lambda r: r["place"])] == list(enumerate(sorted(place, key=lambda k: (place[k], k)), 1))


def test_a_constant_link_is_one_row(spark, tmp_path):
    rows = {f"o/{i}.md": {"c": f"[[c/{i % 5}]]"} for i in range(40)} | {f"c/{i}.md": {} for i in range(4)} | {"o/x.md": {"c": "[[c/4|gone]]"}, "o/y.md": {"c": "[at](../c/3.md)"}, "o/z.md": {}}
    r = from_table(spark.createDataFrame([(p, f.get("c")) for p, f in rows.items()], "path string, c string"), F.col("path"), fields=["c"], link_fields=("c",))
    q = execute(r, {"where": 'file.hasLink("[[c/3#top|a name]]")', "select": ["c"]}, ordered=False)
    assert sorted(paths(q)) == sorted([f"o/{i}.md" for i in range(3, 40, 5)] + ["o/y.md"])
    assert "__want" not in str(q.matched.columns)  # the link isn't written beside every record and joined with the collection
    assert len(paths(execute(r, {"where": 'file.hasLink("[[c/4]]")'}, ordered=False))) == 9  # leads nowhere: equal as texts
    near = execute(r, {"where": 'file.hasLink("[[../c/3]]") && !file.hasLink("[[c/4]]")'}, ordered=False)
    assert sorted(paths(near)) == sorted(paths(q))
