"""Registered queries that go through the functions of both expression languages one by one, with DuckDB SQL beside each."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import links as L
from .plans.legacy_query import execute_legacy
from .queries import NOW, query, records, run, table
from .records import from_table, numbered


def _legacy(r, key: str, forms: dict[str, str], **q):
    return execute_legacy(r, {"formulas": forms, **q}, now=NOW).rows.select(F.col(f"frontmatter.{key}").alias(key), *forms)


# --- the older language: operators ---


@query("""SELECT p_partkey, NOT (p_size > 25) AS negated, p_name || '-' || p_brand AS joined, CAST(-p_size AS DOUBLE) AS minus,
CAST(p_size % 7 AS DOUBLE) AS rest, p_size / 4 AS quarter, p_retailprice * 2 - p_size AS mixed, CAST(p_size AS VARCHAR) || 'x' AS labelled,
CASE WHEN p_size > 40 THEN NULL ELSE p_brand END IS NULL AS missing, coalesce(CASE WHEN p_size <= 40 THEN p_brand END, 'none') AS filled FROM part""")
def legacy_operators(spark, d):
    df = table(spark, d, "part").withColumn("small", F.when(F.col("p_size") <= 40, F.col("p_brand")))
    forms = {"negated": "!(p_size > 25)", "joined": 'p_name + "-" + p_brand', "minus": "-p_size", "rest": "p_size % 7", "quarter": "p_size / 4",
             "mixed": "p_retailprice * 2 - p_size", "labelled": 'p_size + "x"', "missing": "small == null", "filled": 'small ?? "none"'}
    return _legacy(records(spark, d, "part", df), "p_partkey", forms)


@query("""SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[3] AS DOUBLE) AS third, label IN (3, 5) AS listed,
CASE label % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'c' ELSE 'a' END AS picked, label >= 2 AND (label < 5 OR label = 7) AS nested FROM embeddings""")
def legacy_indexing(spark, d):
    forms = {"first": "embedding[0]", "third": "embedding[2]", "listed": "[3, 5].contains(label)", "picked": 'if(label % 3 == 0, "b", if(label % 3 == 1, "c", "a"))', "nested": "label >= 2 && (label < 5 || label == 7)"}
    return _legacy(records(spark, d, "embeddings"), "vec_id", forms)


@query("""SELECT doc_id, CAST(abs(q) AS DOUBLE) AS a, CAST(least(q, 3, n) AS DOUBLE) AS lo, CAST(greatest(q, 3, n) AS DOUBLE) AS hi, CAST(floor(q / 3.0) AS DOUBLE) AS f, CAST(ceil(q / 3.0) + 0.0 AS DOUBLE) AS c,
CAST(floor(q / 4.0 + 0.5) AS DOUBLE) AS r FROM (SELECT doc_id, doc_id % 11 - 5 AS q, n_chars AS n FROM documents)""")
def legacy_numbers(spark, d):
    df = table(spark, d, "documents").withColumn("q", F.col("doc_id") % 11 - 5)
    forms = {"a": "abs(q)", "lo": "min(q, 3, n_chars)", "hi": "max(q, 3, n_chars)", "f": "floor(q / 3)", "c": "ceil(q / 3)", "r": "round(q / 4)"}
    return _legacy(records(spark, d, "documents", df), "doc_id", forms)


@query("""SELECT event_id, user_id % 2 = 0 AS there, user_id % 4 <> 0 AS nothing, CASE WHEN user_id % 4 = 0 THEN 'yes' ELSE 'other' END AS or_else,
CASE WHEN user_id % 2 <> 0 THEN 'null' WHEN user_id % 4 <> 0 THEN 'null' ELSE 'string' END AS kind, 'number' AS num, 'list' AS lst,
user_id % 4 = 0 AS truth, user_id <> 0 AS num_truth, CASE WHEN user_id % 4 = 0 THEN 'yes' ELSE '' END AS text, CAST(value > 5 AS VARCHAR) AS flag FROM events""")
def legacy_kinds(spark, d):
    shape = F.when(F.col("user_id") % 4 == 0, '{"m": "yes"}').when(F.col("user_id") % 2 == 0, '{"m": null}').otherwise("{}")
    df = table(spark, d, "events").withColumn("doc", F.parse_json(shape))
    r = from_table(df, F.concat(F.lit("events/"), "event_id"), fields=["event_id", "user_id", "value", "doc"])
    forms = {"there": "exists(doc.m)", "nothing": "isEmpty(doc.m)", "or_else": 'string(default(doc.m, "other"))', "kind": "type(doc.m)", "num": "type(user_id)", "lst": "type([1, 2])",
             "truth": "isTruthy(doc.m)", "num_truth": "bool(user_id)", "text": "string(doc.m)", "flag": "toString(value > 5)"}
    return _legacy(r, "event_id", forms)


@query("""SELECT event_id, CAST(user_id AS DOUBLE) + 0.5 AS parsed, CAST(epoch_ms(CAST(ts AS DATE)) AS DOUBLE) AS at, upper(event_type) AS up, lower('ABC' || event_type) AS low,
replace(event_type, 'e', '-') AS swapped, CAST(length(event_type) AS DOUBLE) AS n, CAST(length(event_type) AS DOUBLE) AS m, event_type AS linked, CAST(1 AS DOUBLE) AS wrapped FROM events""")
def legacy_conversions(spark, d):
    df = table(spark, d, "events").withColumn("written", F.concat(F.col("user_id"), F.lit(".5"))).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    forms = {"parsed": "number(written)", "at": "int(day)", "up": "upper(event_type)", "low": 'lower("ABC" + event_type)', "swapped": 'replace(event_type, "e", "-")',
             "n": "length(event_type)", "m": "len(event_type)", "linked": "link(event_type)", "wrapped": "list(event_type).length"}
    return _legacy(records(spark, d, "events", df), "event_id", forms)


@query("""SELECT o_orderkey, '2024-03-15' AS today_, '2024-03-15T12:00:00.000Z' AS now_, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS later,
strftime(o_orderdate - INTERVAL 2 MONTH, '%Y-%m-%d') AS before, CAST(90 * 60 * 1000 AS DOUBLE) AS span, o_orderdate < TIMESTAMP '1996-01-01' AS old,
CAST((TIMESTAMP '1999-01-01' - o_orderdate) < INTERVAL 1 DAY * 500 AS BOOLEAN) AS recent FROM orders""")
def legacy_dates(spark, d):
    df = table(spark, d, "orders").withColumn("at", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).withColumn("on", F.date_format("o_orderdate", "yyyy-MM-dd"))
    forms = {"today_": "today()", "now_": "now()", "day": "date(at)", "later": 'on + "10d"', "before": 'on - "2M"', "span": 'duration("90m")', "old": 'on < "1996-01-01"', "recent": '"1999-01-01" - on < duration("500d")'}
    return _legacy(records(spark, d, "orders", df), "o_orderkey", forms)


# --- the older language: methods of texts ---


@query("""SELECT doc_id, contains(w, 'on') AND contains(w, 'e') AS all_, contains(w, 'xyz') OR contains(w, 'en') AS any_, starts_with(w, 'E') AS starts, ends_with(w, '.') AS ends,
regexp_matches(w, '[aeiou]{2}') AS vowels, lower(w) AS low, trim('  ' || w || ' ') AS trimmed, w = '' AS nothing, CAST(length(w) AS DOUBLE) AS n FROM (SELECT doc_id, split_part(text, ' ', 1) AS w FROM documents)""")
def legacy_text_tests(spark, d):
    df = table(spark, d, "documents").withColumn("w", F.split_part("text", F.lit(" "), F.lit(1)))
    forms = {"all_": 'w.containsAll("on", "e")', "any_": 'w.containsAny("xyz", "en")', "starts": 'w.startsWith("E")', "ends": 'w.endsWith(".")', "vowels": 'w.matches("[aeiou]{2}")',
             "low": "w.lower()", "trimmed": '("  " + w + " ").trim()', "nothing": "w.isEmpty()", "n": "w.length()"}
    return _legacy(records(spark, d, "documents", df), "doc_id", forms)


@query("""SELECT p_partkey, string_split(p_name, ' ')[1] AS head, CAST(len(string_split(p_name, ' ')) AS DOUBLE) AS parts, repeat(p_brand, 2) AS twice,
upper(p_name[1:1]) || lower(string_split(p_name, ' ')[1][2:]) || ' ' || upper(string_split(p_name, ' ')[2][1:1]) || lower(string_split(p_name, ' ')[2][2:]) AS titled,
rpad(CAST(p_size AS VARCHAR), 5, '*') AS padded, right(p_name, 3) AS tail, p_size <= 30 AS is_text, CAST(p_size AS VARCHAR) AS as_text, p_name <> '' AS truth FROM part""")
def legacy_text_parts(spark, d):
    df = table(spark, d, "part").withColumn("maybe", F.when(F.col("p_size") <= 30, F.col("p_name")))
    forms = {"head": 'p_name.split(" ", 1)[0]', "parts": 'p_name.split(" ").length', "twice": "p_brand.repeat(2)", "titled": "p_name.title()", "padded": 'string(p_size).padEnd(5, "*")',
             "tail": "p_name.slice(-3)", "is_text": 'maybe.isType("string")', "as_text": "p_size.toString()", "truth": "p_name.isTruthy()"}
    return _legacy(records(spark, d, "part", df.withColumn("maybe", F.coalesce("maybe", F.lit(None).cast("string")))), "p_partkey", forms).withColumn("is_text", F.coalesce("is_text", F.lit(False)))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S') AS clock, strftime(ts, '%d.%m.%Y %H:%M') AS shown, true AS is_at, false AS is_day FROM events""")
def legacy_text_dates(spark, d):
    df = table(spark, d, "events").withColumn("at", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    forms = {"day": "at.date()", "clock": "at.time()", "shown": 'at.format("DD.MM.YYYY HH:mm")', "is_at": 'at.isType("datetime")', "is_day": 'at.isType("date")'}
    return _legacy(records(spark, d, "events", df), "event_id", forms)


# --- the older language: methods of lists ---


@query("""SELECT doc_id, list_contains(w, 'en') AS has_, list_contains(w, 'the') AND list_contains(w, 'on') AS all_, list_contains(w, 'le') OR list_contains(w, 'der') AS any_,
len(w) = 0 AS nothing, CAST(len(w) AS DOUBLE) AS n, array_to_string(w, '+') AS joined, array_to_string(list_reverse(w), ' ') AS back,
array_to_string(list_slice(w, 2, 3), ' ') AS middle, CAST(coalesce(list_position(w, 'en'), 0) - 1 AS DOUBLE) AS at, true AS is_list,
array_to_string(list_transform(w, lambda x: replace(upper(x), 'ẞ', 'SS')), ' ') AS shouted, CAST(len(list_distinct(w)) AS DOUBLE) AS kinds FROM (SELECT doc_id, list_slice(string_split(lower(text), ' '), 1, 6) AS w FROM documents)""")
def legacy_list_methods(spark, d):
    df = table(spark, d, "documents").withColumn("w", F.slice(F.split(F.lower("text"), " "), 1, 6))
    forms = {"has_": 'w.contains("en")', "all_": 'w.containsAll("the", "on")', "any_": 'w.containsAny("le", "der")', "nothing": "w.isEmpty()", "n": "w.length()", "joined": 'w.join("+")',
             "back": 'w.reverse().join(" ")', "middle": 'w.slice(1, 3).join(" ")', "at": 'w.indexOf("en")', "is_list": 'w.isType("list")', "shouted": 'w.map(value.upper()).join(" ")', "kinds": "w.unique().length"}
    return _legacy(records(spark, d, "documents", df), "doc_id", forms)


@query("""SELECT o_orderkey, array_to_string(list_sort([lower(o_orderpriority[3:]), lower(o_orderstatus), 'm']), ',') AS sorted, array_to_string([o_orderstatus, 'x', o_orderpriority], '|') AS flat,
CAST(list_sum(list_transform(range(1, 4), lambda x: x * (o_orderkey % 10))) AS DOUBLE) AS total FROM orders""")
def legacy_list_order(spark, d):
    df = table(spark, d, "orders").withColumn("ws", F.array(F.expr("substring(o_orderpriority, 3)"), F.col("o_orderstatus"), F.lit("m"))).withColumn("nested", F.array(F.array(F.col("o_orderstatus"), F.lit("x")), F.array("o_orderpriority")))
    df = df.withColumn("three", F.array(*[F.lit(k) * (F.col("o_orderkey") % 10) for k in (1, 2, 3)]))
    forms = {"sorted": 'ws.map(value.lower()).sort().join(",")', "flat": 'nested.flat().join("|")', "total": "three.reduce(acc + value, 0)"}
    return _legacy(records(spark, d, "orders", df), "o_orderkey", forms)


# --- CEL ---


@query("""SELECT event_id, CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) - 1 AS BIGINT) AS mo, CAST(day(ts) AS BIGINT) AS dd, CAST(day(ts) - 1 AS BIGINT) AS dm, CAST(dayofweek(ts) AS BIGINT) AS dw,
CAST(dayofyear(ts) - 1 AS BIGINT) AS dy, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS mi, CAST(floor(second(ts)) AS BIGINT) AS s,
CAST(hour(timezone('Asia/Tokyo', timezone('UTC', ts))) AS BIGINT) AS tokyo FROM events""")
def cel_timestamp_parts(spark, d):
    parts = {"y": "getFullYear()", "mo": "getMonth()", "dd": "getDate()", "dm": "getDayOfMonth()", "dw": "getDayOfWeek()", "dy": "getDayOfYear()", "h": "getHours()", "mi": "getMinutes()", "s": "getSeconds()", "tokyo": 'getHours("Asia/Tokyo")'}
    return run(records(spark, d, "events"), select=["event_id", *[{"name": n, "expr": f"ts.{e}"} for n, e in parts.items()]]).values


@query("""SELECT event_id, ts + INTERVAL 90 MINUTE > TIMESTAMP '2024-01-10' AS late, CAST(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) // 3600 AS BIGINT) AS hours,
ts >= TIMESTAMP '2024-01-05 06:00:00' AS since, ts - TIMESTAMP '2024-01-01' < INTERVAL 36 HOUR AS soon, ts < TIMESTAMP '2024-03-15 12:00:00' AS past FROM events""")
def cel_durations(spark, d):
    s = {"late": 'ts + duration("90m") > timestamp("2024-01-10T00:00:00Z")', "hours": '(ts - timestamp("2024-01-01T00:00:00Z")).getHours()', "since": 'ts >= timestamp("2024-01-05T06:00:00Z")',
         "soon": 'ts - timestamp("2024-01-01T00:00:00Z") < duration("36h")', "past": "ts < now()"}
    return run(records(spark, d, "events"), select=["event_id", *[{"name": n, "expr": e} for n, e in s.items()]]).values


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate - INTERVAL 6 HOUR, '%Y-%m-%d') AS from_text, o_orderdate >= TIMESTAMP '1996-05-01 00:00:00' AS after_start FROM orders""")
def cel_dates(spark, d):
    df = table(spark, d, "orders").withColumn("written", F.date_format(F.col("o_orderdate") - F.expr("INTERVAL 6 HOURS"), "yyyy-MM-dd"))
    s = {"day": "date(o_orderdate)", "from_text": "date(written)", "after_start": 'o_orderdate >= startOfDay("1996-05-01")'}
    return run(records(spark, d, "orders", df), select=["o_orderkey", *[{"name": n, "expr": e} for n, e in s.items()]]).values


@query("""SELECT p_partkey, CAST(p_size + 1 AS BIGINT) AS i, CAST(p_size AS BIGINT) AS u, p_size + 0.5 AS dbl, CAST(p_size AS VARCHAR) || '!' AS txt, p_size > 25 AS b, CAST(strlen(p_name) AS BIGINT) AS n_bytes,
'string' AS t1, 'int' AS t2, 'double' AS t3, CAST(p_size * 3 % 7 AS BIGINT) AS arithmetic, -p_retailprice AS minus FROM part""")
def cel_conversions(spark, d):
    df = table(spark, d, "part").withColumn("digits", F.col("p_size").cast("string")).withColumn("yes", (F.col("p_size") > 25).cast("string"))
    s = {"i": "int(digits) + 1", "u": "int(uint(p_size))", "dbl": 'double(digits + ".5")', "txt": 'string(p_size) + "!"', "b": "bool(yes)", "n_bytes": "size(bytes(p_name))", "t1": "type(p_name)", "t2": "type(p_size)",
         "t3": "type(p_retailprice)", "arithmetic": "p_size * 3 % 7", "minus": "-p_retailprice"}
    return run(records(spark, d, "part", df), select=["p_partkey", *[{"name": n, "expr": e} for n, e in s.items()]]).values


@query("""SELECT event_id, coalesce(CASE WHEN user_id % 3 = 1 THEN user_id END, -1) AS inner_value, coalesce(CASE WHEN user_id % 3 = 1 THEN user_id END, event_id) AS first_of, user_id % 3 = 1 AS there,
CASE WHEN user_id % 3 = 1 THEN user_id + 1 ELSE 0 END AS guarded FROM events""")
def cel_optionals(spark, d):
    shape = F.when(F.col("user_id") % 3 == 0, "{}").when(F.col("user_id") % 3 == 1, F.concat(F.lit('{"a": {"b": '), "user_id", F.lit("}}"))).otherwise('{"a": null}')
    df = table(spark, d, "events").withColumn("deep", F.parse_json(shape))
    r = from_table(df, F.concat(F.lit("events/"), "event_id"), fields=["event_id", "user_id", "deep"])
    s = {"inner_value": "int(deep.?a.?b.orValue(-1))", "first_of": "int(deep.?a.?b.or(event_id).orValue(0))", "there": "deep.?a.?b.hasValue()", "guarded": "deep.?a.?b.hasValue() ? int(deep.a.b) + 1 : 0"}
    return run(r, select=["event_id", *[{"name": n, "expr": e} for n, e in s.items()]]).values


@query("""SELECT n_nationkey, CAST(3 AS BIGINT) AS n, CAST([n_nationkey, 5, 7][2] AS BIGINT) AS second, n_nationkey IN (2, 3, 5) AS member, 'b' AS by_key, n_name IN ('NATION_1', 'NATION_4') AS keyed,
CAST(n_nationkey % 2 + 1 AS BIGINT) AS mapped FROM nation""")
def cel_literals(spark, d):
    s = {"n": "size([1, 2, 3])", "second": "[n_nationkey, 5, 7][1]", "member": "n_nationkey in [2, 3, 5]", "by_key": '{"a": "b"}["a"]', "keyed": 'n_name in {"NATION_1": 1, "NATION_4": 2}', "mapped": "dyn([1, 2])[n_nationkey % 2]"}
    return run(records(spark, d, "nation"), select=["n_nationkey", *[{"name": n, "expr": e} for n, e in s.items()]]).values


# --- files, groups, orders, types ---


@query("""SELECT doc_id, '[[documents/' || doc_id || ']]' AS own, 'documents/' || doc_id AS path, CAST(doc_id AS VARCHAR) AS name, 'documents' AS folder, lang || ',from/' || source AS tags FROM documents""")
def file_facts(spark, d):
    tags = F.array(F.concat(F.lit("#"), F.col("lang")), F.concat_ws("/", F.lit("#from"), F.col("source")))
    r = records(spark, d, "documents", fields=["doc_id", "lang", "source"], tags=tags)
    got = run(r, select=["doc_id", {"name": "own", "expr": "file.asLink()"}, "file.path", "file.name", "file.folder", {"name": "tags", "expr": "file.tags"}]).values
    return got.withColumn("tags", F.array_join(F.array_sort("tags"), ","))


@query("""SELECT row_number() OVER (ORDER BY l_shipmonth DESC NULLS FIRST, l_returnflag) AS place, l_shipmonth, l_returnflag, count(*) AS count FROM
(SELECT CASE WHEN month(l_shipdate) < 11 THEN month(l_shipdate) END AS l_shipmonth, l_returnflag FROM lineitem) GROUP BY 2, 3""")
def group_order(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.when(F.month("l_shipdate") < 11, F.month("l_shipdate").cast("long")).alias("l_shipmonth"))
    q = run(records(spark, d, "lineitem", df), group_by=[{"field": "l_shipmonth", "direction": "desc"}, {"field": "l_returnflag"}], summaries=[{"field": "l_orderkey", "function": "count", "name": "all"}])
    # the groups come in their order; their number shows it
    return numbered(q.groups).select("place", "l_shipmonth", "l_returnflag", "count")


@query("""SELECT row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place, o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 500""")
def order_dates(spark, d):
    q = run(records(spark, d, "orders"), order_by=[{"field": "o_orderdate", "direction": "desc"}, {"field": "o_orderkey"}], select=["o_orderkey"], limit=500)
    return numbered(q.values).select("place", "o_orderkey")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'vendor' WHEN s_suppkey % 3 = 1 THEN 'maker,vendor' ELSE '' END AS types FROM supplier""")
def explicit_types(spark, d):
    from .operators.membership import TypeRule, with_types

    df = table(spark, d, "supplier").withColumn("type", F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("Vendor"))).when(F.col("s_suppkey") % 3 == 1, F.array(F.lit("vendor"), F.lit("maker"))))
    r = with_types(records(spark, d, "supplier", df, types=()), [TypeRule("vendor"), TypeRule("maker")], keys=("type",))
    return r.df.select(F.col("fields.s_suppkey").alias("s_suppkey"), F.array_join(F.array_sort("types"), ",").alias("types"))


@query("""SELECT doc_id, CAST(len(regexp_extract_all(body, '!\\[\\[')) AS BIGINT) AS embeds, CAST(1 AS BIGINT) AS links,
'a' || (doc_id % 7) || ',b/' || lang AS tags FROM (SELECT doc_id, lang, 'See [[n' || doc_id || ']] and ![[pic.png]]' || CASE WHEN doc_id % 2 = 0 THEN ' ![[two|t]]' ELSE '' END AS body FROM documents)""")
def file_embeds(spark, d):
    body = F.concat(F.lit("See [[n"), "doc_id", F.lit("]] and ![[pic.png]]"), F.when(F.col("doc_id") % 2 == 0, " ![[two|t]]").otherwise(""), F.lit(" #a"), F.col("doc_id") % 7, F.lit(" `#code [[no]]` #b/"), "lang", F.lit(" x#no\n"))
    got = L.with_links(records(spark, d, "documents", fields=["doc_id"], body=body, parse_body=True))
    return got.select("fields.doc_id", F.size("file_embeds").cast("long").alias("embeds"), F.size("file_links").cast("long").alias("links"), F.array_join(F.array_sort("file_tags"), ",").alias("tags"))


@query("""SELECT p_partkey, CAST(p_size AS BIGINT) AS doubled, p_retailprice + 0.25 AS price, p_size > 25 AS flag, CAST(p_size AS VARCHAR) AS code, p_size % 10 = 0 AS odd_one,
row_number() OVER (ORDER BY p_size, p_partkey) AS place FROM part""")
def read_coercion(spark, d):
    """Texts, numbers and words of the stored records, read as their declared types: they add, compare and order as such."""
    from .operators.coercion import coerced
    from .queries import ranked

    df = table(spark, d, "part").select(
        "p_partkey", F.concat(F.lit(" "), F.col("p_size").cast("string")).alias("size"), F.col("p_retailprice").cast("string").alias("price"),
        F.when(F.col("p_size") > 25, F.when(F.col("p_partkey") % 2 == 0, "Yes").otherwise("on")).otherwise("FALSE").alias("flag"), F.col("p_size").alias("code"),
        F.when(F.col("p_size") % 10 == 0, "many").otherwise("1e1").alias("odd"),
    )
    r = from_table(df, F.concat(F.lit("part/"), "p_partkey"))
    r = coerced(r, {"size": {"type": "integer"}, "price": {"type": "number"}, "flag": {"type": "boolean"}, "code": {"type": "string"}, "odd": {"type": "integer"}})
    s = {"doubled": "int(size)", "price": "double(price) + 0.25", "flag": "flag == true", "code": "string(code)", "odd_one": 'odd == "many" && odd != 10'}
    q = run(r, select=["p_partkey", *[{"name": n, "expr": e} for n, e in s.items()]], order_by=[{"field": "size"}, {"field": "p_partkey"}])
    return ranked(q.values)


@query("""SELECT o_orderstatus AS key, o_orderkey, dense_rank() OVER (ORDER BY o_orderstatus DESC) AS group_place, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS place FROM orders""")
def legacy_group_rows(spark, d):
    from pyspark.sql import Window

    q = execute_legacy(records(spark, d, "orders"), {"group_by": {"property": "o_orderstatus", "direction": "DESC"}, "order_by": [{"field": "o_totalprice"}, {"field": "o_orderkey"}]})
    rows, groups = numbered(q.group_rows.select("key", "frontmatter.o_orderkey"), "__i"), numbered(q.groups.select("key", "n_rows"), "group_place")
    # a row per group: how many rows stand before it
    before = F.coalesce(F.sum("n_rows").over(Window.orderBy("group_place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select(F.col("key").alias("__key"), "group_place", before.alias("__before"))
    joined = rows.join(F.broadcast(groups), F.col("key").eqNullSafe(F.col("__key")))
    return joined.select("key", "o_orderkey", "group_place", (F.col("__i") - F.col("__before")).alias("place"))


@query("""SELECT path, code, field FROM (SELECT 'part/' || p_partkey AS path, unnest(list_filter([
  CASE WHEN p_size < 5 THEN {'code': 'number_too_small', 'field': 'p_size'} END, CASE WHEN p_size > 45 THEN {'code': 'number_too_large', 'field': 'p_size'} END,
  CASE WHEN length(p_name) < 9 THEN {'code': 'string_too_short', 'field': 'p_name'} END, CASE WHEN length(p_name) > 11 THEN {'code': 'string_too_long', 'field': 'p_name'} END,
  CASE WHEN NOT regexp_matches(p_brand, '^Brand#[1-5]$') THEN {'code': 'pattern_mismatch', 'field': 'p_brand'} END,
  CASE WHEN p_type NOT IN ('ECONOMY', 'STANDARD') THEN {'code': 'invalid_enum', 'field': 'p_type'} END,
  CASE WHEN p_size % 6 = 0 THEN {'code': 'invalid_date', 'field': 'day'} END], lambda x: x IS NOT NULL), recursive := true) FROM part)""")
def field_checks(spark, d):
    """The kinds of checks that a declared field can have, on one table."""
    from .operators.rules import Type, validate

    df = table(spark, d, "part").drop("p_retailprice").withColumn("day", F.when(F.col("p_size") % 6 == 0, "someday").otherwise("2024-02-29"))
    t = Type("part", {"p_partkey": {"type": "integer"}, "p_size": {"type": "integer", "min": 5, "max": 45}, "p_name": {"type": "string", "min_length": 9, "max_length": 11},
                      "p_brand": {"type": "string", "pattern": "^Brand#[1-5]$"}, "p_type": {"type": "enum", "values": ["ECONOMY", "STANDARD"]}, "day": {"type": "date"}})
    return validate(records(spark, d, "part", df), [t]).select("path", "code", "field")


@query("""SELECT 'part/' || p_partkey AS path, 'unknown_field' AS code, 'p_size' AS field FROM part UNION ALL SELECT 'part/' || p_partkey, 'deprecated_field', 'p_type' FROM part""")
def field_names_checked(spark, d):
    """Fields that no type declares, and ones that are given up."""
    from .operators.rules import Type, validate

    df = table(spark, d, "part").drop("p_retailprice")
    t = Type("part", {"p_partkey": {"type": "integer"}, "p_name": {"type": "string"}, "p_brand": {"type": "string"}, "p_type": {"type": "string", "deprecated": True}}, strict=True)
    return validate(records(spark, d, "part", df), [t]).select("path", "code", "field")


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE list_contains(tags, 'A') AND list_contains(tags, '3') OR list_contains(tags, 'x4')
""".replace("FROM lineitem", "FROM (SELECT *, [l_returnflag, CAST(l_linenumber AS VARCHAR), 'x' || l_suppkey % 9] AS tags FROM lineitem)"))
def where_structured_lists(spark, d):
    df = table(spark, d, "lineitem").withColumn("tags", F.array("l_returnflag", F.col("l_linenumber").cast("string"), F.concat(F.lit("x"), F.col("l_suppkey") % 9)))
    q = execute_legacy(records(spark, d, "lineitem", df), {"where": {"or": [{"tags": {"containsAll": ["A", "3"]}}, {"tags": {"containsAny": ["x4", "nothing"]}}]}})
    return q.rows.select("frontmatter.l_orderkey", F.col("frontmatter.l_linenumber").cast("long").alias("l_linenumber"))


@query("""SELECT row_number() OVER (ORDER BY n_name COLLATE NOCASE, n_nationkey) AS place, n_nationkey FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Z' || chr(CAST(97 + n_nationkey AS INTEGER)) ELSE 'a' || chr(CAST(97 + n_nationkey AS INTEGER)) END AS n_name FROM nation)""")
def default_order(spark, d):
    """Without order_by rows stand by path, in Unicode order."""
    from .plans.query import execute
    from .queries import ranked

    df = table(spark, d, "nation").withColumn("p", F.concat(F.when(F.col("n_nationkey") % 2 == 0, "Z").otherwise("a"), F.expr("char(97 + n_nationkey)")))
    r = from_table(df, F.col("p"), fields=["n_nationkey"])
    return ranked(execute(r, {"select": ["n_nationkey"]}).values)
