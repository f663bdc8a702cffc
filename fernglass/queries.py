"""Registered queries over the driver's tables, each through the engine's own API, with DuckDB SQL beside it."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.globs import glob_regex
from .operators import links as L
from .operators import writes as W
from .operators.changes import snapshot_diff
from .operators.contracts import Contract, contract_issues, contract_view
from .operators.jsonschema import schema_issues
from .operators.membership import TypeRule, with_defaults, with_types
from .operators.rules import Type, filename_issues, link_issues, unique_issues, validate
from .plans.legacy_query import execute_legacy
from .plans.query import execute
from .plans.views import Views
from .records import Records, from_table, numbered, once

NOW = datetime(2024, 3, 15, 12, 0, tzinfo=timezone.utc)
KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "events": "event_id", "documents": "doc_id", "labels": "doc_id", "pages": "page_id", "benchmark": "item_id", "embeddings": "vec_id",
}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def path_of(name: str):
    if name == "lineitem":
        return F.concat(F.lit("lineitem/"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber"))
    if name == "conversations":
        return F.concat(F.lit("conversations/"), F.col("conv_id"), F.lit("-"), F.col("turn"))
    return F.concat(F.lit(f"{name}/"), F.col(KEYS[name]))


def records(spark: SparkSession, d: str, name: str, df: DataFrame | None = None, **options) -> Records:
    df = table(spark, d, name) if df is None else df
    return from_table(df, path_of(name), types=options.pop("types", (name,)), **options)


def run(r: Records, **q):
    return execute(r, q, now=NOW, ordered=False)


# --- filters and projections ---

FLAGSHIP = {
    "where": 'l_quantity >= 25.0 && l_returnflag != "N"',
    "order_by": [{"field": "l_extendedprice", "direction": "desc"}, {"field": "l_orderkey"}, {"field": "l_linenumber"}],
    "select": ["l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag"],
    "limit": 120,
}


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, l_returnflag FROM lineitem WHERE l_quantity >= 25.0 AND l_returnflag <> 'N'
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 120""")
def query_basic(spark, d):
    return execute(records(spark, d, "lineitem"), FLAGSHIP).values


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 25.0 AND l_returnflag <> 'N' AND l_discount < 0.05")
def where_cel_basic(spark, d):
    q = run(records(spark, d, "lineitem"), where='l_quantity >= 25.0 && l_returnflag != "N" && l_discount < 0.05', select=["l_orderkey", "l_linenumber", "l_quantity"])
    return q.values


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size_class FROM orders
WHERE (o_orderstatus IN ('F', 'O') OR o_totalprice > 200000) AND NOT (o_orderpriority = '1-URGENT')""")
def where_cel_logic(spark, d):
    q = run(records(spark, d, "orders"), where='(o_orderstatus in ["F", "O"] || o_totalprice > 200000.0) && !(o_orderpriority == "1-URGENT")',
            select=["o_orderkey", {"name": "size_class", "expr": 'o_totalprice > 100000.0 ? "big" : "small"'}])
    return q.values


def _structured(r: Records, where: dict) -> DataFrame:
    return execute_legacy(r, {"where": where}).rows.select(F.col("frontmatter.*"))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AND o_totalprice > 1000 AND o_totalprice <= 250000
AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND o_custkey IS NOT NULL""")
def where_structured_ops(spark, d):
    where = {"o_orderstatus": {"eq": "F"}, "o_orderpriority": {"neq": "5-LOW", "in": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}, "o_totalprice": {"gt": 1000, "lte": 250000}, "o_custkey": {"exists": True}}
    return _structured(records(spark, d, "orders"), where).select("o_orderkey", "o_totalprice")


@query("""SELECT doc_id FROM documents WHERE starts_with(text, 'T') AND ends_with(text, '.') AND contains(text, ' the ') AND regexp_matches(text, 'on[a-z]+ing')""")
def where_structured_text(spark, d):
    return _structured(records(spark, d, "documents"), {"text": {"startsWith": "T", "ends_with": ".", "contains": " the ", "matches": "on[a-z]+ing"}}).select("doc_id")


@query("""SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR (o_totalprice >= 150000 AND o_orderstatus = 'P')) AND NOT (o_orderpriority = '4-NOT SPECIFIED')""")
def where_structured_nested(spark, d):
    where = {"and": [{"or": [{"o_orderstatus": "O"}, {"o_totalprice": {"gte": 150000}, "o_orderstatus": {"eq": "P"}}]}, {"not": {"o_orderpriority": {"eq": "4-NOT SPECIFIED"}}}]}
    return _structured(records(spark, d, "orders"), where).select("o_orderkey")


RULES = [
    TypeRule("Open", where={"o_orderstatus": "O"}),
    TypeRule("urgent", expr='o_orderpriority.startsWith("1") || o_orderpriority.startsWith("2")'),
    TypeRule("tens", path_glob=("orders/*0",)),
    TypeRule("priced", fields_present=("o_totalprice",), where={"o_totalprice": {"gt": 200000}}),
]


@query("""SELECT * FROM (SELECT o_orderkey, array_to_string(list_sort(list_filter([CASE WHEN o_orderstatus = 'O' THEN 'open' END,
CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'urgent' END, CASE WHEN o_orderkey % 10 = 0 THEN 'tens' END,
CASE WHEN o_totalprice > 200000 THEN 'priced' END], lambda x: x IS NOT NULL)), ',') AS types FROM orders) WHERE types LIKE '%urgent%' OR types LIKE '%tens%'""")
def match_types(spark, d):
    r = with_types(records(spark, d, "orders"), RULES)
    from .operators.membership import filter_types

    return filter_types(r, ["URGENT", "tens"]).df.select(F.col("fields.o_orderkey").alias("o_orderkey"), F.array_join(F.array_sort("types"), ",").alias("types"))


@query("""SELECT source || '/' || lang || '/' || doc_id AS path FROM documents WHERE regexp_matches(source || '/' || lang || '/' || doc_id, '^src[0-9]/e[^/]/[^/]*[13579]$')""")
def glob_match(spark, d):
    df = table(spark, d, "documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return df.where(F.col("path").rlike(glob_regex("src[0-9]/e?/*[13579]")))


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, net * (1.0 + l_tax) AS gross FROM
(SELECT *, l_extendedprice * (1.0 - l_discount) AS net FROM lineitem) WHERE net > 50000.0""")
def projections_dag(spark, d):
    q = run(records(spark, d, "lineitem"), projections={"gross": {"expr": "projection.net * (1.0 + l_tax)"}, "net": {"expr": "l_extendedprice * (1.0 - l_discount)"}},
            where="projection.net > 50000.0", select=["l_orderkey", "l_linenumber", {"name": "gross", "expr": "projection.gross"}])
    return q.values


@query("SELECT p_partkey, upper(p_brand) AS brand, p_retailprice / p_size AS price_per_size, p_type FROM part")
def select_expr(spark, d):
    return run(records(spark, d, "part"), select=["p_partkey", {"name": "brand", "expr": "p_brand.upper()", "label": "Brand"}, {"name": "price_per_size", "expr": "p_retailprice / double(p_size)"}, "p_type"]).values


# --- order, page ---


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 20")
def order_topk(spark, d):
    return run(records(spark, d, "orders"), select=["o_orderkey", "o_totalprice"], order_by=[{"field": "o_totalprice", "direction": "desc"}, {"field": "o_orderkey"}], offset=20, limit=50).values


def ranked(df: DataFrame) -> DataFrame:
    """Rows with their place in the order they come in."""
    return numbered(df)


@query("""SELECT row_number() OVER (ORDER BY big DESC NULLS FIRST, o_orderkey) AS place, * FROM (SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN o_totalprice END AS big FROM orders)""")
def order_nulls(spark, d):
    q = run(records(spark, d, "orders"), select=["o_orderkey", {"name": "big", "expr": "o_totalprice > 150000.0 ? o_totalprice : null"}],
            order_by=[{"field": "big", "direction": "desc"}, {"field": "o_orderkey"}])
    return ranked(q.values)


PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "1-URGENT", "2-HIGH", "3-MEDIUM"]


@query("""SELECT row_number() OVER (ORDER BY list_position(['5-LOW', '4-NOT SPECIFIED', '1-URGENT', '2-HIGH', '3-MEDIUM'], o_orderpriority), o_orderkey) AS place, o_orderkey, o_orderpriority FROM orders""")
def order_enum(spark, d):
    q = execute_legacy(records(spark, d, "orders"), {"order_by": [{"field": "o_orderpriority"}, {"field": "o_orderkey"}]}, enums={"o_orderpriority": PRIORITIES})
    return ranked(q.rows.select("frontmatter.o_orderkey", "frontmatter.o_orderpriority"))


@query("SELECT count(*) AS total_count, count(*) > 30 AS has_more FROM orders WHERE o_totalprice > 100000")
def paging_meta(spark, d):
    return run(records(spark, d, "orders"), where="o_totalprice > 100000.0", offset=10, limit=20).meta()


@query("""SELECT row_number() OVER (ORDER BY c_mktsegment DESC, c_name) AS place, c_name, c_mktsegment FROM customer""")
def order_text(spark, d):
    return ranked(run(records(spark, d, "customer"), select=["c_name", "c_mktsegment"], order_by=[{"field": "c_mktsegment", "direction": "desc"}, {"field": "c_name"}]).values)


# --- groups and summaries ---


@query("SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY ALL")
def group_multi(spark, d):
    return run(records(spark, d, "lineitem"), group_by=[{"field": "l_returnflag"}, {"field": "l_linestatus", "direction": "desc"}]).groups


@query("""SELECT d.lang, count(*) AS n, count(toxic) AS known, count(*) - count(toxic) AS missing, count(*) AS count FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang""")
def summary_count_filled_empty(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    s = [{"field": "toxic", "function": f, "name": n} for f, n in (("count", "n"), ("filled", "known"), ("empty", "missing"))]
    return run(records(spark, d, "documents", df), group_by=[{"field": "lang"}], summaries=s).groups.select("lang", "n", "known", "missing", "count")


@query("""SELECT l_returnflag, count(*) AS count, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY l_returnflag""")
def summary_sum_avg(spark, d):
    s = [{"field": "l_quantity", "function": "sum", "name": "qty"}, {"field": "l_extendedprice", "function": "average", "name": "price"}]
    g = run(records(spark, d, "lineitem"), group_by=[{"field": "l_returnflag"}], summaries=s).groups
    return g.select("l_returnflag", "count", F.round("qty", 2).alias("qty"), F.round("price", 4).alias("price"))


@query("SELECT o_orderstatus, count(*) AS count, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY o_orderstatus")
def summary_min_max(spark, d):
    s = [{"field": "o_totalprice", "function": "minimum", "name": "least"}, {"field": "o_totalprice", "function": "maximum", "name": "most"}]
    return run(records(spark, d, "orders"), group_by=[{"field": "o_orderstatus"}], summaries=s).groups


@query("""SELECT event_type, count(*) AS count, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY event_type""")
def summary_earliest_latest(spark, d):
    s = [{"field": "ts", "function": "earliest", "name": "first"}, {"field": "ts", "function": "latest", "name": "last"}]
    g = run(records(spark, d, "events"), group_by=[{"field": "event_type"}], summaries=s).groups
    return g.select("event_type", "count", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"))


@query("SELECT count(*) AS count, CAST(NULL AS DOUBLE) AS total FROM orders WHERE o_totalprice < 0")
def summary_global_empty(spark, d):
    return run(records(spark, d, "orders"), where="o_totalprice < 0.0", summaries=[{"field": "o_totalprice", "function": "sum", "name": "total"}]).groups


@query("""SELECT o_orderstatus, count(*) AS count, count(*) FILTER (o_totalprice > 1000.0) AS over, bool_or(o_totalprice > 400000.0) AS any_huge FROM orders GROUP BY o_orderstatus""")
def summary_udaf(spark, d):
    own = {"over": {"expr": "values.filter(v, v > 1000.0).size()"}, "any_huge": {"expr": "values.exists(v, v > 400000.0)"}}
    s = [{"field": "o_totalprice", "function": f} for f in own]
    return run(records(spark, d, "orders"), group_by=[{"field": "o_orderstatus"}], summary_functions=own, summaries=s).groups


@query("SELECT n_regionkey, count(*) AS count, array_to_string(list(n_name ORDER BY 'nation/' || n_nationkey), ';') AS names FROM (SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, n_name, n_nationkey FROM nation) GROUP BY n_regionkey")
def summary_udaf_list(spark, d):
    own = {"names": {"expr": "values.map(v, v)"}}
    g = run(records(spark, d, "nation"), group_by=[{"field": "n_regionkey"}], summary_functions=own, summaries=[{"field": "n_name", "function": "names"}]).groups
    return g.select("n_regionkey", "count", F.array_join("names", ";").alias("names"))


@query("""SELECT quality AS key, count(*) AS n_rows, round(avg(toxic), 6) AS mean, CAST(sum(toxic) AS DOUBLE) AS total, CAST(count(DISTINCT doc_id) AS BIGINT) AS ids,
CAST(count(*) FILTER (toxic = 1) AS BIGINT) AS checked, CAST(count(*) FILTER (toxic = 0) AS BIGINT) AS unchecked FROM (SELECT CAST(quality AS BIGINT) AS quality, toxic, doc_id FROM labels) GROUP BY quality""")
def legacy_summaries(spark, d):
    df = table(spark, d, "labels").select("doc_id", "quality", F.col("toxic").alias("mean"), F.col("toxic").alias("total"), F.col("doc_id").alias("ids"), (F.col("toxic") == 1).alias("checked"), (F.col("toxic") == 1).alias("unchecked"))
    q = {"group_by": {"property": "quality"}, "property_summaries": {"mean": "Average", "total": "Sum", "ids": "Unique", "checked": "Checked", "unchecked": "Unchecked"}}
    g = execute_legacy(records(spark, d, "labels", df), q).groups
    return g.withColumn("mean", F.round("mean", 6))


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, charge FROM (SELECT *, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem)
WHERE charge / l_quantity < 1200 AND l_returnflag <> 'R'""")
def legacy_formulas(spark, d):
    q = {"formulas": {"unit": "formula.charge / l_quantity", "charge": "l_extendedprice * (1 - l_discount) * (1 + l_tax)", "returned": 'l_returnflag == "R"'}, "where": "formula.unit < 1200 && !formula.returned"}
    return execute_legacy(records(spark, d, "lineitem"), q).rows.select("frontmatter.l_orderkey", F.col("frontmatter.l_linenumber").cast("long").alias("l_linenumber"), "charge")


@query("""SELECT p_partkey, upper(left(p_name, 3)) AS a, CAST(strlen(p_name) AS DOUBLE) AS n, replace(p_type, 'A', 'a') AS r, CAST(instr(p_name, 'a') - 1 AS DOUBLE) AS i,
lpad(CAST(p_size AS VARCHAR), CAST(greatest(4, len(CAST(p_size AS VARCHAR))) AS INTEGER), '0') AS padded, reverse(p_brand) AS rev FROM part WHERE contains(p_brand, '#1') OR p_size > 40""")
def legacy_strings(spark, d):
    forms = {"a": "p_name.slice(0, 3).upper()", "n": "p_name.length", "r": 'p_type.replace("A", "a")', "i": 'p_name.indexOf("a")', "padded": 'string(p_size).padStart(4, "0")', "rev": "p_brand.reverse()"}
    q = execute_legacy(records(spark, d, "part"), {"formulas": forms, "where": 'p_brand.contains("#1") || p_size > 40'})
    return q.rows.select("frontmatter.p_partkey", *forms)


@query("""SELECT vec_id, CAST(len(list_filter(e, lambda x: x > 0)) AS DOUBLE) AS pos, list_sum(list_filter(e, lambda x: x > 0)) > 1 AS heavy FROM
(SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)""")
def legacy_lists(spark, d):
    forms = {"pos": "embedding.filter(value > 0).length", "heavy": "embedding.filter(value > 0).reduce(acc + value, 0) > 1"}
    return execute_legacy(records(spark, d, "embeddings"), {"formulas": forms}).rows.select("frontmatter.vec_id", *forms)


# --- time ---


@query("""SELECT event_id, CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS m, CAST(day(ts) AS BIGINT) AS dd, CAST(isodow(ts) AS BIGINT) AS dow, CAST(hour(ts) AS BIGINT) AS h FROM events""")
def date_parts(spark, d):
    s = [{"name": n, "expr": f"date(ts).{f}()"} for n, f in (("y", "year"), ("m", "month"), ("dd", "day"), ("dow", "dayOfWeek"))]
    return run(records(spark, d, "events"), select=["event_id", *s, {"name": "h", "expr": "ts.getHours()"}]).values


@query("""SELECT o_orderkey, strftime(o_orderdate + INTERVAL 45 DAY, '%Y-%m-%d') AS later, strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month,
strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 YEAR, '%Y-%m-%d') AS next_year, date_diff('day', CAST(o_orderdate AS DATE), DATE '2024-03-15') AS age FROM orders""")
def date_arith(spark, d):
    s = [{"name": "later", "expr": "date(o_orderdate).addDays(45)"}, {"name": "next_month", "expr": "date(o_orderdate).addMonths(1)"},
         {"name": "next_year", "expr": "date(o_orderdate).addYears(1)"}, {"name": "age", "expr": "date(o_orderdate).daysUntil(today())"}]
    return run(records(spark, d, "orders"), select=["o_orderkey", *s]).values


@query("""SELECT event_id, strftime(timezone('Australia/Melbourne', timezone('UTC', ts)), '%Y-%m-%d') AS local_day FROM events
WHERE strftime(timezone('Australia/Melbourne', timezone('UTC', ts)), '%Y-%m-%d') <> strftime(ts, '%Y-%m-%d')""")
def date_timezone(spark, d):
    r = records(spark, d, "events")
    q = run(r, timezone="Australia/Melbourne", projections={"day": {"expr": "date(ts)"}}, where='projection.day != string(ts).matches("^$") && ts >= startOfDay(projection.day) && !string(ts).startsWith(projection.day)',
            select=["event_id", {"name": "local_day", "expr": "projection.day"}])
    return q.values


# --- texts, lists, nested fields ---


@query("""SELECT p_partkey, lower(p_type) AS low, upper(p_name) AS up, CAST(length(p_name) AS BIGINT) AS n, contains(p_type, 'BRASS') OR starts_with(p_brand, 'Brand#1') AS hit FROM part""")
def string_fns(spark, d):
    s = [{"name": "low", "expr": "p_type.lower()"}, {"name": "up", "expr": "p_name.upper()"}, {"name": "n", "expr": "size(p_name)"}, {"name": "hit", "expr": 'p_type.contains("BRASS") || p_brand.startsWith("Brand#1")'}]
    return run(records(spark, d, "part"), select=["p_partkey", *s]).values


@query("""SELECT vec_id, CAST(len(list_filter(e, lambda x: x > 0)) AS BIGINT) AS pos, list_max(e) > 0.3 AS any_big, list_min(e) > -0.9 AS all_ok, round(list_transform(e, lambda x: x * 2.0)[1], 6) AS twice, CAST(len(e) AS BIGINT) AS n
FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)""")
def list_macros(spark, d):
    s = [{"name": "pos", "expr": "embedding.filter(x, x > 0.0).size()"}, {"name": "any_big", "expr": "embedding.exists(x, x > 0.3)"}, {"name": "all_ok", "expr": "embedding.all(x, x > -0.9)"},
         {"name": "twice", "expr": "embedding.map(x, x * 2.0)[0]"}, {"name": "n", "expr": "embedding.size()"}]
    return run(records(spark, d, "embeddings"), select=["vec_id", *s]).values.withColumn("twice", F.round("twice", 6))


def _with_props(spark, d) -> Records:
    df = table(spark, d, "events").withColumn("props", once(F.parse_json("props")))
    return records(spark, d, "events", df)


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) + 1 AS k1, CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS r, CAST(json_extract(props, '$.k') AS BIGINT) > 50 AS big FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) <> 7 AND CAST(json_extract(props, '$.k') AS BIGINT) > 20""")
def json_field(spark, d):
    q = run(_with_props(spark, d), where="props.k != 7 && props.k > 20", select=["event_id", {"name": "k1", "expr": "double(props.k) + 1.0"}, {"name": "r", "expr": "int(props.k) % 3"}, {"name": "big", "expr": "props.k > 50"}])
    return q.values


@query("""SELECT event_id, event_id % 3 <> 0 AS there, event_id % 3 = 1 AS is_null FROM events""")
def exists_missing_vs_null(spark, d):
    shape = F.when(F.col("event_id") % 3 == 0, "{}").when(F.col("event_id") % 3 == 1, '{"k": null}').otherwise('{"k": 1}')
    df = table(spark, d, "events").withColumn("props", F.parse_json(shape))
    q = run(records(spark, d, "events", df), select=["event_id", {"name": "there", "expr": "has(props.k)"}, {"name": "is_null", "expr": "has(props.k) && props.k == null"}])
    return q.values


@query("""SELECT doc_id FROM documents WHERE lang = 'de' OR source = 'src3'""")
def has_tag_prefix(spark, d):
    tags = F.array(F.concat(F.lit("#"), F.col("lang")), F.concat_ws("/", F.lit("from"), F.col("source"), F.lit("x")))
    r = records(spark, d, "documents", fields=["doc_id", "lang", "source"], tags=tags)
    return run(r, where='file.hasTag("#de") || file.hasTag("from/src3")', select=["doc_id"]).values


@query("""SELECT doc_id, source AS folder FROM documents WHERE source IN ('src1', 'src2') OR (source = 'src4' AND lang = 'fr')""")
def in_folder(spark, d):
    df = table(spark, d, "documents")
    r = from_table(df, F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), fields=["doc_id", "lang", "source"])
    return run(r, where='file.inFolder("/src1/") || file.inFolder("src2") || file.inFolder("src4/fr")', select=["doc_id", {"name": "folder", "expr": "source"}]).values


# --- links ---


def _orders_and_customers(spark, d) -> Records:
    o = table(spark, d, "orders").select(F.concat(F.lit("orders/"), "o_orderkey").alias("path"), F.col("o_orderkey").alias("key"), F.concat(F.lit("[[customer/"), "o_custkey", F.lit("]]")).alias("customer"), F.lit(None).cast("string").alias("name"), F.col("o_totalprice").alias("amount"), F.lit("orders").alias("kind"))
    c = table(spark, d, "customer").select(F.concat(F.lit("customer/"), "c_custkey").alias("path"), F.col("c_custkey").alias("key"), F.lit(None).cast("string").alias("customer"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"), F.lit("customer").alias("kind"))
    df = o.unionByName(c)
    r = from_table(df, F.col("path"), fields=["key", "customer", "name", "amount", "kind"], link_fields=("customer",))
    return r.with_df(r.df.withColumn("types", F.array(F.col("fields.kind"))))


@query("""SELECT o_orderkey AS key, c_name AS customer_name, c_acctbal AS balance FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 50000""")
def link_resolve_path(spark, d):
    q = run(_orders_and_customers(spark, d), types=["orders"], where="amount > 50000.0", select=["key", {"name": "customer_name", "expr": "customer.asFile().name"}, {"name": "balance", "expr": "customer.asFile().amount"}])
    return q.values


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, 'parts/p' || l_partkey AS target FROM lineitem")
def link_resolve_id(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("parts/p"), "p_partkey").alias("path"), F.col("p_partkey").cast("string").alias("id"))
    target = from_table(p, F.col("path"), fields=["id"], id_field="id")
    links = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.concat(F.lit("[["), "l_partkey", F.lit("]]")).alias("link"))
    return L.resolve(links, F.col("link"), F.lit("lineitem/x"), target, "r").select("l_orderkey", "l_linenumber", F.col("r.path").alias("target"))


@query("""WITH files AS (SELECT 'r' || n_regionkey || '/' || n_name AS path, n_name AS name, 2 AS depth FROM nation UNION ALL SELECT 'deep/r' || n_regionkey || '/' || n_name, n_name, 3 FROM nation
UNION ALL SELECT 'other/' || n_name, n_name, 2 FROM nation WHERE n_nationkey % 2 = 0),
wanted AS (SELECT n_nationkey, n_name, 'deep/r' || n_regionkey || '/from' AS src FROM nation UNION ALL SELECT n_nationkey, n_name, 'elsewhere/from' FROM nation),
ranked AS (SELECT w.*, f.path, row_number() OVER (PARTITION BY w.src, w.n_nationkey ORDER BY CASE WHEN regexp_replace(w.src, '/[^/]*$', '') = regexp_replace(f.path, '/[^/]*$', '') THEN 0 ELSE 1 END, depth, f.path) AS rn
FROM wanted w JOIN files f ON w.n_name = f.name) SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, src, path AS target FROM ranked WHERE rn = 1""")
def link_resolve_basename_ties(spark, d):
    n = table(spark, d, "nation")
    paths = n.select(F.concat(F.lit("r"), "n_regionkey", F.lit("/"), "n_name").alias("path")).union(n.select(F.concat(F.lit("deep/r"), "n_regionkey", F.lit("/"), "n_name"))).union(n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("other/"), "n_name")))
    files = from_table(paths, F.col("path"))
    src = n.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.concat(F.lit("deep/r"), "n_regionkey", F.lit("/from")).alias("src")).union(n.select(F.col("n_nationkey").cast("long"), "n_name", F.lit("elsewhere/from")))
    got = L.resolve(src.withColumn("link", F.concat(F.lit("[["), "n_name", F.lit("]]"))), F.col("link"), F.col("src"), files, "r")
    return got.select("n_nationkey", "src", F.col("r.path").alias("target"))


@query("""SELECT page_id, regexp_extract(h, '^href="([^"]*)"$', 1) AS url, CAST(i AS BIGINT) AS pos FROM (SELECT page_id, unnest(l) AS h, unnest(range(0, len(l))) AS i FROM
(SELECT page_id, regexp_extract_all(html, 'href="[^"]*"') AS l FROM pages))""")
def link_extract(spark, d):
    md = table(spark, d, "pages").select("page_id", F.array_join(F.transform(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), lambda u: F.concat(F.lit("[x]("), u, F.lit(")"))), "\n").alias("body"))
    got = md.select("page_id", F.posexplode(L.body_facts("body")["links"]).alias("pos", "link"))
    p = L.parse_link(F.col("link"))
    return got.select("page_id", F.concat(p["target"], F.coalesce(F.concat(F.lit("#"), p["anchor"]), F.lit(""))).alias("url"), F.col("pos").cast("long").alias("pos"))


@query("""SELECT 'customer/' || o_custkey AS path, count(*) AS n_backlinks FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey""")
def backlinks_count(spark, d):
    return L.backlink_counts(_orders_and_customers(spark, d))


@query("""SELECT c_custkey AS key, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")
def backlinks_of_file(spark, d):
    return run(_orders_and_customers(spark, d), types=["customer"], select=["key", {"name": "n", "expr": "file.backlinks.size()"}]).values


@query("SELECT o_orderkey AS key FROM orders WHERE o_custkey = 7 OR o_custkey = 13")
def has_link_semi(spark, d):
    return run(_orders_and_customers(spark, d), types=["orders"], where='file.hasLink("[[customer/7]]") || file.hasLink("[[customer/13|a name]]")', select=["key"]).values


@query("""SELECT 'lineitem/' || l_orderkey || '-' || l_linenumber AS src, '[[part/' || (l_partkey * 2) || ']]' AS link FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey * 2)""")
def link_broken_anti(spark, d):
    line = table(spark, d, "lineitem").select(path_of("lineitem").alias("path"), F.concat(F.lit("[[part/"), (F.col("l_partkey") * 2).cast("string"), F.lit("]]")).alias("part"))
    part = table(spark, d, "part").select(path_of("part").alias("path"), F.lit(None).cast("string").alias("part"))
    return L.broken_links(from_table(line.unionByName(part), F.col("path"), fields=["part"], link_fields=("part",)))


@query("""SELECT c_custkey, c_acctbal - (SELECT c_acctbal FROM customer WHERE c_custkey = 5) AS more FROM customer WHERE c_mktsegment = (SELECT c_mktsegment FROM customer WHERE c_custkey = 5)""")
def this_context(spark, d):
    q = run(records(spark, d, "customer"), context={"this": {"path": "customer/5"}}, where="c_mktsegment == this.c_mktsegment", select=["c_custkey", {"name": "more", "expr": "c_acctbal - this.c_acctbal"}])
    return q.values


# --- rules ---


@query("""SELECT path, 'duplicate_value' AS code, 'conv_id' AS field FROM (SELECT 'conversations/' || conv_id || '-' || turn AS path, row_number() OVER (PARTITION BY conv_id ORDER BY CAST(turn AS VARCHAR)) AS rn FROM conversations) WHERE rn > 1""")
def unique_violations(spark, d):
    return unique_issues(records(spark, d, "conversations"), "conv_id").select("path", "code", "field")


ORDER_TYPE = Type("orders", {
    "o_orderkey": {"type": "integer", "required": True, "min": 10}, "o_totalprice": {"type": "number", "max": 300000}, "o_orderstatus": {"type": "enum", "values": ["O", "F"]},
    "o_orderpriority": {"type": "string", "pattern": "^[1-4]", "max_length": 10}, "o_clerk": {"type": "string", "required": True},
})


@query("""SELECT path, code, field FROM (SELECT 'orders/' || o_orderkey AS path, * FROM orders), LATERAL (SELECT * FROM (VALUES
('number_too_small', 'o_orderkey', o_orderkey < 10), ('number_too_large', 'o_totalprice', o_totalprice > 300000), ('invalid_enum', 'o_orderstatus', o_orderstatus NOT IN ('O', 'F')),
('pattern_mismatch', 'o_orderpriority', NOT regexp_matches(o_orderpriority, '^[1-4]')), ('string_too_long', 'o_orderpriority', length(o_orderpriority) > 10), ('missing_required', 'o_clerk', true)) t(code, field, bad)) WHERE bad""")
def validate_fields(spark, d):
    return validate(records(spark, d, "orders"), [ORDER_TYPE]).select("path", "code", "field")


PART_SCHEMA = {
    "type": "object", "required": ["p_partkey", "p_container"],
    "properties": {
        "p_size": {"type": "integer", "minimum": 5, "exclusiveMaximum": 45, "multipleOf": 1}, "p_retailprice": {"type": "number", "maximum": 1900},
        "p_brand": {"type": "string", "pattern": "^Brand#[1-4]", "minLength": 3}, "p_type": {"anyOf": [{"pattern": "BRASS"}, {"pattern": "STEEL"}, {"maxLength": 12}]},
        "p_name": {"$ref": "#/$defs/name"},
    },
    "$defs": {"name": {"type": "string", "maxLength": 14}},
    "if": {"properties": {"p_size": {"minimum": 40}}}, "then": {"properties": {"p_retailprice": {"minimum": 1000}}},
}


@query("""SELECT path, code, field FROM (SELECT 'part/' || p_partkey AS path, * FROM part), LATERAL (SELECT * FROM (VALUES ('schema_required', 'p_container', true), ('schema_minimum', 'p_size', p_size < 5),
('schema_exclusive_maximum', 'p_size', p_size >= 45), ('schema_maximum', 'p_retailprice', p_retailprice > 1900), ('schema_pattern', 'p_brand', NOT regexp_matches(p_brand, '^Brand#[1-4]')),
('schema_any_of', 'p_type', NOT (contains(p_type, 'BRASS') OR contains(p_type, 'STEEL') OR length(p_type) <= 12)), ('schema_max_length', 'p_name', length(p_name) > 14),
('schema_minimum', 'p_retailprice', p_size >= 40 AND p_retailprice < 1000)) t(code, field, bad)) WHERE bad""")
def validate_schema(spark, d):
    return schema_issues(records(spark, d, "part"), PART_SCHEMA, ["part"]).select("path", "code", "field")


@query("""SELECT 'orders/' || o_orderkey AS path, 'link_not_found' AS code FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey + 500)""")
def validate_links(spark, d):
    o = table(spark, d, "orders").select(path_of("orders").alias("path"), F.concat(F.lit("[[customer/"), (F.col("o_custkey") + 500).cast("string"), F.lit("]]")).alias("customer"))
    c = table(spark, d, "customer").select(path_of("customer").alias("path"), F.lit(None).cast("string").alias("customer"))
    return link_issues(from_table(o.unionByName(c), F.col("path"), fields=["customer"]), "customer").select("path", "code")


@query("SELECT 'nation/' || n_nationkey AS path, 'filename_mismatch' AS code FROM nation WHERE n_nationkey <> n_regionkey")
def validate_filename(spark, d):
    return filename_issues(records(spark, d, "nation"), "{n_regionkey}").select("path", "code")


PARTY = Contract("party", {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "minLength": 1}, "nation": {"type": "integer"}, "balance": {"type": "number", "minimum": 0}}},
                 {"customer": {"name": "c_name", "nation": "c_nationkey", "balance": "c_acctbal"}, "supplier": {"name": "s_name", "nation": "s_nationkey", "balance": "s_acctbal"}})


def _parties(spark, d) -> DataFrame:
    return contract_view([(records(spark, d, "customer"), "customer"), (records(spark, d, "supplier"), "supplier")], PARTY)


@query("""SELECT 'customer/' || c_custkey AS path, 'customer' AS type, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS balance FROM customer
UNION ALL SELECT 'supplier/' || s_suppkey, 'supplier', s_name, s_nationkey, s_acctbal FROM supplier""")
def contract_union(spark, d):
    return _parties(spark, d)


@query("""SELECT 'customer/' || c_custkey AS path, 'data_contract_record_invalid' AS code, 'balance' AS field FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'supplier/' || s_suppkey, 'data_contract_record_invalid', 'balance' FROM supplier WHERE s_acctbal < 0""")
def contract_violations(spark, d):
    return contract_issues(_parties(spark, d), PARTY).select("path", "code", "field")


@query("SELECT d.doc_id, coalesce(CAST(toxic AS BIGINT), -1) AS toxic, coalesce(CAST(quality AS BIGINT), 0) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def read_defaults(spark, d):
    df = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return run(with_defaults(records(spark, d, "documents", df), {"toxic": -1, "quality": 0}), select=["doc_id", "toxic", "quality"]).values


VIEWS = Views({"views/orders": {
    "id": "order-views", "name": "Orders", "version": 1,
    "query": {"types": ["orders"], "where": "o_totalprice > 100000.0", "projections": {"vat": {"expr": "o_totalprice * 0.2"}}},
    "views": [{"id": "open", "name": "Open", "where": 'o_orderstatus == "O"', "select": ["o_orderkey", {"name": "vat", "expr": "projection.vat"}], "order_by": [{"field": "o_orderkey"}], "context": {"this": {"on_missing": "null"}}}],
}})


@query("SELECT o_orderkey, o_totalprice * 0.2 AS vat FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
def view_exec(spark, d):
    return VIEWS.execute(records(spark, d, "orders"), "order-views", "open").values


# --- snapshots and writes ---


@query("""SELECT event, path FROM (SELECT 'orders/' || o_orderkey AS path, CASE WHEN o_orderkey % 7 = 0 THEN 'file_deleted' WHEN o_orderkey % 11 = 0 THEN 'file_created' WHEN o_orderkey % 5 = 0 THEN 'file_modified' END AS event FROM orders) WHERE event IS NOT NULL""")
def snapshot_changes(spark, d):
    r = records(spark, d, "orders")
    key = F.col("fields.o_orderkey")
    old = r.with_df(r.df.where(~((key % 11 == 0) & (key % 7 != 0))))
    new = W.batch_update(r.with_df(r.df.where(key % 7 != 0)), {"o_orderstatus": F.lit("X")}, "o_orderkey % 5 == 0")
    return snapshot_diff(old, new).select("event", "path")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'H' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def batch_update(spark, d):
    return W.batch_update(records(spark, d, "orders"), {"o_orderstatus": "H"}, "o_totalprice > 200000.0").df.select("fields.o_orderkey", "fields.o_orderstatus")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 100000)")
def batch_delete(spark, d):
    return W.batch_delete(records(spark, d, "orders"), {"o_orderstatus": "F", "o_totalprice": {"lt": 100000}}).df.select("fields.o_orderkey")


@query("""SELECT path, CASE WHEN turn % 2 = 0 THEN turn ELSE mx + rn END AS seq, coalesce(role2, 'none') AS role2 FROM (SELECT *, CASE WHEN turn % 2 = 1 THEN row_number() OVER (PARTITION BY turn % 2 ORDER BY path) END AS rn,
max(CASE WHEN turn % 2 = 0 THEN turn END) OVER () AS mx FROM (SELECT *, 'conversations/' || conv_id || '-' || turn AS path, CASE WHEN turn % 3 = 0 THEN role END AS role2 FROM conversations))""")
def backfill(spark, d):
    df = table(spark, d, "conversations").withColumn("seq", F.when(F.col("turn") % 2 == 0, F.col("turn"))).withColumn("role2", F.when(F.col("turn") % 3 == 0, F.col("role")))
    r = W.backfill(records(spark, d, "conversations", df, fields=["seq", "role2"]), {"role2": "none"}, sequence="seq")
    return r.df.select("path", "fields.seq", "fields.role2")


@query("SELECT c_custkey, CASE WHEN c_custkey > 0 THEN lower(replace(c_name, '#', '-')) || '-of-segment-' || lower(c_mktsegment) END AS slug, CASE WHEN c_custkey > 0 THEN '2024-03-15' END AS seen, c_name AS shown FROM customer")
def lifecycle(spark, d):
    df = table(spark, d, "customer").withColumn("label", F.concat("c_name", F.lit("  Of Segment_"), "c_mktsegment", F.lit(" ")))
    r = records(spark, d, "customer", df, fields=["c_custkey", "c_name", "label"])
    r = W.lifecycle(r, [{"if": "c_custkey > 0", "set": {"slug": {"slugify": "label"}, "seen": {"today": True}}}, {"set": {"shown": {"copy": "c_name"}}}], NOW)
    return r.df.select("fields.c_custkey", "fields.slug", "fields.seen", "fields.shown")
