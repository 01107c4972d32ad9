"""Every operator as a query over the test tables, with the SQL that gives the same rows.

Base collections: orders (key o_orderkey; ``status`` is o_orderstatus with P as null), part (key p_partkey; ``tags`` are the
words of p_name), customer, events (times with microseconds), documents, nation (string key n_name) and lineitem (numbered
rows, for aggregates). Filters are shown by the keys they select.
"""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import QuarryError
from .expr import (
    AND, ASC, AVG, CONTAINS, COUNT, DESC, DISTINCT, EQ, EXISTS, GT, GTE, HAS, HASALL, HASANY, HASNONE, IN, ISNULL, LEN, LT, LTE, MAX, MIN, NE, NOT, NOTIN, NOTNULL, OR, OUT, POS, PREFIX, Q,
    ROWCOUNT, SUFFIX, SUM, aggregate, query,
)
from .patch import convert, make_patch
from .schema import KEY, Field, Schema
from .sources.collection import Collection
from .sources.store import Store, StoredCollection
from .sources.trace import Tracer

Build = Callable[[SparkSession, str], DataFrame]


def orders(spark: SparkSession, sf_dir: str) -> Collection:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("status", F.expr("nullif(o_orderstatus, 'P')"))
    return Collection(df, Schema.of(df, "o_orderkey", "orders"))


def part(spark: SparkSession, sf_dir: str) -> Collection:
    df = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("tags", F.split("p_name", " "))
    return Collection(df, Schema.of(df, "p_partkey", "part"))


def customer(spark: SparkSession, sf_dir: str) -> Collection:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("balance", F.expr("nullif(cast(round(c_acctbal) as bigint), 0)"))
    return Collection(df, Schema.of(df, "c_custkey", "customer", measures=["balance"]))


def events(spark: SparkSession, sf_dir: str) -> Collection:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return Collection(df, Schema.of(df, "event_id", "events"))


def documents(spark: SparkSession, sf_dir: str) -> Collection:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return Collection(df, Schema.of(df, "doc_id", "documents"))


def nation(spark: SparkSession, sf_dir: str) -> Collection:
    df = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return Collection(df, Schema.of(df, "n_name", "nation", string_key_index=True))


def lineitem(spark: SparkSession, sf_dir: str) -> Collection:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("row", F.monotonically_increasing_id())
    return Collection(df, Schema.of(df, "row", "lineitem", measures=["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


_ORDERS = "(select *, nullif(o_orderstatus, 'P') as status from orders)"
_PART = "(select *, string_split(p_name, ' ') as tags from part)"
_CUSTOMER = "(select *, nullif(cast(round(c_acctbal) as bigint), 0) as balance from customer)"
_SECOND = "cast(floor(epoch(ts)) as bigint)"


def _keys(collection, q: Q) -> Build:
    return lambda spark, sf_dir: collection(spark, sf_dir).query_keys(q)


def _placed(collection, q: Q) -> Build:
    """The keys of a whole sorted query, each with its place from 1 on: the sorted partitions are written, so that they stay as they
    are, and the places in a partition follow the rows of those before it. Only their counts are summed in one task."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{_folder(spark)}/order-{uuid.uuid4().hex}"
        keys = collection(spark, sf_dir).query_keys(q)
        keys.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
        written = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
        before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        counts = written.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        bases = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
        place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_base") + 1
        return written.join(bases, "_part").select(*keys.columns, place.alias("place"))

    return build


def _records(collection, q: Q) -> Build:
    return lambda spark, sf_dir: collection(spark, sf_dir).query(q)


def _reduced(collection, q: Q) -> Build:
    return lambda spark, sf_dir: collection(spark, sf_dir).aggregate(q)


_TIME = dt.datetime(2024, 1, 1, 4, 51, 20, 500_000)


def _filters() -> dict[str, tuple[Build, str]]:
    def o(q, where):
        return _keys(orders, query(q) if not isinstance(q, Q) else q), f"select o_orderkey from {_ORDERS} where {where}"

    def p(q, where):
        return _keys(part, query(q)), f"select p_partkey from {_PART} where {where}"

    def e(q, where):
        return _keys(events, query(q)), f"select event_id from events where {where}"

    has = "list_contains(tags, '{}')".format
    return {
        "eq": o(EQ("o_orderstatus", "O"), "o_orderstatus = 'O'"),
        "ne": o(NE("o_orderpriority", "1-URGENT"), "o_orderpriority <> '1-URGENT'"),
        "gt": o(GT("o_totalprice", 250000), "o_totalprice > 250000"),
        "gte": o(GTE("o_custkey", 100), "o_custkey >= 100"),
        "lt": o(LT("o_totalprice", 50000.5), "o_totalprice < 50000.5"),
        "lte": o(LTE("o_custkey", 40), "o_custkey <= 40"),
        "range_merge": o(Q((GTE("o_custkey", 20), LT("o_custkey", 90), GT("o_custkey", 30))), "o_custkey > 30 and o_custkey < 90"),
        "in": o(IN("o_orderpriority", ["1-URGENT", "5-LOW"]), "o_orderpriority in ('1-URGENT', '5-LOW')"),
        "in_null": o(IN("status", ["F", None]), "status = 'F' or status is null"),
        "notin": o(NOTIN("status", ["F"]), "status is null or status <> 'F'"),
        "notin_null": o(NOTIN("status", ["F", None]), "status is not null and status <> 'F'"),
        "isnull": o(ISNULL("status"), "status is null"),
        "notnull": o(NOTNULL("status"), "status is not null"),
        "eq_null": o(EQ("status", None), "status is null"),
        "ne_includes_null": o(NE("status", "F"), "status is distinct from 'F'"),
        "not_range_includes_null": o(NOT(GT("status", "G")), "status is null or status <= 'G'"),
        "prefix": o(PREFIX("o_orderpriority", "4-"), "starts_with(o_orderpriority, '4-')"),
        "prefix_empty": o(PREFIX("status", ""), "status is not null"),
        "suffix": o(SUFFIX("o_orderpriority", "IUM"), "ends_with(o_orderpriority, 'IUM')"),
        "contains": (_keys(documents, query(CONTAINS("text", "tion of"))), "select doc_id from documents where contains(text, 'tion of')"),
        "and": o(AND(EQ("o_orderstatus", "O"), GT("o_totalprice", 100000)), "o_orderstatus = 'O' and o_totalprice > 100000"),
        "or": o(OR(EQ("status", "F"), LT("o_custkey", 10), GT("o_totalprice", 300000)), "coalesce(status = 'F', false) or o_custkey < 10 or o_totalprice > 300000"),
        "not_group": o(NOT(OR(EQ("status", "F"), GT("o_custkey", 50))), "status is distinct from 'F' and o_custkey <= 50"),
        "double_not": o(NOT(NOT(EQ("status", "O"))), "status = 'O'"),
        "const_true": o(Q(), "true"),
        "const_false": o(LT("status", None), "false"),
        "float_bound_on_int": o(GT("o_custkey", 99.5), "o_custkey >= 100"),
        "float_eq_on_int": o(EQ("o_custkey", 7.5), "false"),
        "out_of_range_literal": o(LT("o_custkey", 2**70), "true"),
        "hasall": p(HASALL("tags", ["blue", "rod"]), f"{has('blue')} and {has('rod')}"),
        "hasany": p(HASANY("tags", ["blue", "rod", "large"]), f"{has('blue')} or {has('rod')} or {has('large')}"),
        "hasnone": p(HASNONE("tags", ["blue", "red"]), f"not {has('blue')} and not {has('red')}"),
        "has": p(HAS("tags", "gizmo"), has("gizmo")),
        "set_eq": p(EQ("tags", ["widget", "blue", "blue"]), f"len(list_distinct(tags)) = 2 and {has('blue')} and {has('widget')}"),
        "set_eq_empty": p(EQ("tags", []), "len(tags) = 0"),
        "array_any_range": p(GT("tags", "t"), "len(list_filter(tags, lambda x: x > 't')) > 0"),
        "array_any_prefix": p(PREFIX("tags", "b"), "len(list_filter(tags, lambda x: starts_with(x, 'b'))) > 0"),
        "time_eq_second": e(EQ("ts", _TIME), f"{_SECOND} = epoch(timestamp '2024-01-01 04:51:20')::bigint"),
        "time_range": e(AND(GT("ts", _TIME), LTE("ts", _TIME + dt.timedelta(days=3))), f"{_SECOND} > epoch(timestamp '2024-01-01 04:51:20')::bigint and {_SECOND} <= epoch(timestamp '2024-01-04 04:51:20')::bigint"),
        "time_unix": e(GTE("ts", 1704888000), f"{_SECOND} >= 1704888000"),
        "key_eq": o(EQ(KEY, 42), "o_orderkey = 42"),
        "key_in": o(IN(KEY, [1, 5, 9, -3]), "o_orderkey in (1, 5, 9)"),
        "key_range": o(AND(GTE(KEY, 100), LT(KEY, 200)), "o_orderkey >= 100 and o_orderkey < 200"),
        "key_string": (_keys(nation, query(PREFIX(KEY, "N"))), "select n_name from nation where starts_with(n_name, 'N')"),
    }


def _orderings() -> dict[str, tuple[Build, str]]:
    def o(q, tail):
        return _keys(orders, q), f"select o_orderkey from {_ORDERS} {tail}"

    def p(q, tail):
        return _keys(part, q), f"select p_partkey from {_PART} {tail}"

    def o_all(q, order, where=""):
        return _placed(orders, q), f"select o_orderkey, row_number() over (order by {order}) as place from {_ORDERS} {where}"

    def p_all(q, order, where=""):
        return _placed(part, q), f"select p_partkey, row_number() over (order by {order}) as place from {_PART} {where}"

    places = "case {} when '3-MEDIUM' then 0 when '1-URGENT' then 1 end".format("o_orderpriority")
    array_places = "case when list_contains(tags, 'rod') then 0 when list_contains(tags, 'blue') then 1 end"
    urgent = ["3-MEDIUM", "1-URGENT", "3-MEDIUM"]
    return {
        "flagship": (
            _records(orders, query(EQ("o_orderstatus", "O"), GTE("o_totalprice", 100000)).sort("o_totalprice", DESC).limit(10)),
            f"select * from {_ORDERS} where o_orderstatus = 'O' and o_totalprice >= 100000 order by o_totalprice desc, o_orderkey limit 10",
        ),
        "sort_asc": o_all(query().sort("o_totalprice"), "o_totalprice, o_orderkey"),
        "sort_desc": o_all(query().sort("o_custkey", DESC), "o_custkey desc, o_orderkey"),
        "sort_nulls_last_asc": o_all(query().sort("status"), "status asc nulls last, o_orderkey"),
        "sort_nulls_last_desc": o_all(query().sort("status", DESC), "status desc nulls last, o_orderkey"),
        "sort_time_second": (_placed(events, query().sort("ts", DESC)), f"select event_id, row_number() over (order by {_SECOND} desc, event_id) as place from events"),
        "sort_array_min": p_all(query().sort("tags"), "list_min(tags), p_partkey", "where len(tags) > 0"),
        "sort_array_max": p_all(query().sort("tags", DESC), "list_max(tags) desc, p_partkey", "where len(tags) > 0"),
        "len_asc": p_all(query().sort_by(LEN("tags")), "len(list_distinct(tags)), p_partkey"),
        "len_desc": p_all(query().sort_by(LEN("tags"), DESC), "len(list_distinct(tags)) desc, p_partkey"),
        "pos_scalar_asc": o_all(query().sort_by(POS("o_orderpriority", urgent)), f"{places} asc nulls last, o_orderkey"),
        "pos_scalar_desc": o_all(query().sort_by(POS("o_orderpriority", urgent), DESC), f"{places} desc nulls last, o_orderkey"),
        "pos_null_rank": o_all(query().sort_by(POS("status", [None, "O"])), "case when status is null then 0 when status = 'O' then 1 end nulls last, o_orderkey"),
        "pos_array_asc": p_all(query().sort_by(POS("tags", ["rod", "blue"])), f"{array_places} asc nulls last, p_partkey"),
        "pos_array_desc": p_all(query().sort_by(POS("tags", ["rod", "blue"]), DESC), f"{array_places} desc nulls last, p_partkey"),
        "pos_empty": o_all(query().sort_by(POS("o_orderstatus", [])), "o_orderkey"),
        "key_asc": o_all(query(GT("o_custkey", 5)).sort(KEY), "o_orderkey", "where o_custkey > 5"),
        "key_desc": o_all(query().sort(KEY, DESC), "o_orderkey desc"),
        "top_sort": o(query().sort("o_custkey", DESC).limit(100), "order by o_custkey desc, o_orderkey limit 100"),
        "top_time": (_keys(events, query().sort("ts", DESC).limit(50)), f"select event_id from events order by {_SECOND} desc, event_id limit 50"),
        "top_len": p(query().sort_by(LEN("tags"), DESC).limit(30), "order by len(list_distinct(tags)) desc, p_partkey limit 30"),
        "top_pos_scalar": o(query().sort_by(POS("o_orderpriority", urgent)).limit(500), f"order by {places} asc nulls last, o_orderkey limit 500"),
        "top_pos_array": p(query().sort_by(POS("tags", ["rod", "blue"])).limit(60), f"order by {array_places} asc nulls last, p_partkey limit 60"),
        "offset_limit": o(query(EQ("o_orderstatus", "F")).sort("o_totalprice").offset(40).limit(20), "where o_orderstatus = 'F' order by o_totalprice, o_orderkey limit 20 offset 40"),
        "offset_past_end": o(query(EQ(KEY, 1)).sort("o_totalprice").offset(5), "where o_orderkey = 1 order by o_totalprice limit 10 offset 5"),
        "unordered_limit_by_key": o(query(EQ("o_orderstatus", "O")).limit(100), "where o_orderstatus = 'O' order by o_orderkey limit 100"),
        "or_ordered": o(query(OR(EQ("o_orderstatus", "F"), GT("o_totalprice", 200000))).sort("o_totalprice", DESC).offset(10).limit(30), "where o_orderstatus = 'F' or o_totalprice > 200000 order by o_totalprice desc, o_orderkey limit 30 offset 10"),
        "query_records": (_records(customer, query(PREFIX("c_mktsegment", "B"))), f"select * from {_CUSTOMER} where starts_with(c_mktsegment, 'B')"),
        "scan_seek": (lambda spark, sf_dir: customer(spark, sf_dir).scan(100), f"select * from {_CUSTOMER} where c_custkey >= 100 order by c_custkey"),
        "scan_keys": (lambda spark, sf_dir: nation(spark, sf_dir).scan_keys("J"), "select n_name from nation where n_name >= 'J' order by n_name"),
        "get": (_got, f"select k as asked, c_custkey is not null as found, c_name from (values (7), (1), (1000000000), (-5)) v(k) left join {_CUSTOMER} on c_custkey = k"),
    }


def _aggregates() -> dict[str, tuple[Build, str]]:
    def o(q, sql):
        return _reduced(orders, q), sql.replace("ORDERS", _ORDERS)

    def c(q, sql):
        return _reduced(customer, q), sql.replace("CUSTOMER", _CUSTOMER)

    rows = ROWCOUNT().AS("rows")
    price = "cast(round(sum(l_extendedprice), 2) as double)"
    return {
        "count_all": (lambda s, d: orders(s, d).count_of(), "select count(*) as count from orders"),
        "count_filter": (lambda s, d: orders(s, d).count_of(NE("status", "F"), LT("o_custkey", 100)), f"select count(*) as count from {_ORDERS} where status is distinct from 'F' and o_custkey < 100"),
        "rowcount": o(query(GT("o_custkey", 10)).metrics(ROWCOUNT()), "select count(*) as count from ORDERS where o_custkey > 10"),
        "count_field": o(aggregate(COUNT("status")), "select count(status) as count_status from ORDERS"),
        "count_distinct": o(aggregate(COUNT(DISTINCT("o_custkey"))), "select count(distinct o_custkey) as count_distinct_o_custkey from ORDERS"),
        "sum_int": o(aggregate(SUM("o_custkey")), "select cast(sum(o_custkey) as bigint) as sum_o_custkey from ORDERS"),
        "sum_float": (lambda s, d: lineitem(s, d).aggregate(aggregate(SUM("l_quantity").AS("q"))), "select sum(l_quantity) as q from lineitem"),
        "sum_empty": c(query(EQ(KEY, -1)).metrics(SUM("balance").AS("s"), AVG("balance").AS("a"), MIN("balance").AS("m"), rows), "select cast(0 as bigint) as s, cast(null as double) as a, cast(null as bigint) as m, cast(0 as bigint) as rows"),
        "avg": c(aggregate(AVG("balance").AS("a")), "select avg(balance) as a from CUSTOMER"),
        "min_max_num": c(aggregate(MIN("balance").AS("lo"), MAX("balance").AS("hi")), "select min(balance) as lo, max(balance) as hi from CUSTOMER"),
        "min_max_str": o(aggregate(MIN("status").AS("lo"), MAX("o_orderpriority").AS("hi")), "select min(status) as lo, max(o_orderpriority) as hi from ORDERS"),
        "min_max_time": (_reduced(events, aggregate(MIN("ts").AS("lo"), MAX("ts").AS("hi"))), f"select min({_SECOND}) as lo, max({_SECOND}) as hi from events"),
        "min_max_bool": (lambda s, d: _with_flag(s, d).aggregate(Q(groups=("o_orderpriority",)).metrics(MIN("big").AS("lo"), MAX("big").AS("hi"))), "select o_orderpriority, min(o_totalprice > 100) as lo, max(o_totalprice > 100) as hi from orders group by 1"),
        "distinct": o(aggregate(DISTINCT("o_orderpriority")), "select distinct o_orderpriority as distinct_o_orderpriority from ORDERS"),
        "distinct_null": o(aggregate(DISTINCT("status")), "select distinct status as distinct_status from ORDERS"),
        "distinct_window": o(aggregate(DISTINCT("o_custkey")).offset(5).limit(10), "select distinct o_custkey as distinct_o_custkey from ORDERS order by 1 limit 10 offset 5"),
        "group1": o(Q().group("o_orderpriority").metrics(rows, COUNT("status")), "select o_orderpriority, count(*) as rows, count(status) as count_status from ORDERS group by 1"),
        "group2": o(Q().group("status", "o_orderpriority").metrics(rows, MAX("o_custkey").AS("m")), "select status, o_orderpriority, count(*) as rows, max(o_custkey) as m from ORDERS group by 1, 2"),
        "group_null": o(Q().group("status").metrics(rows), "select status, count(*) as rows from ORDERS group by 1"),
        "group_only": o(Q().group("status", "o_orderpriority"), "select distinct status, o_orderpriority from ORDERS"),
        "group_time": (_reduced(events, Q().group("ts").metrics(rows)), f"select {_SECOND} as ts, count(*) as rows from events group by 1"),
        "count_distinct_grouped": o(Q().group("o_orderpriority").metrics(COUNT(DISTINCT("o_custkey")).AS("n"), rows), "select o_orderpriority, count(distinct o_custkey) as n, count(*) as rows from ORDERS group by 1"),
        "having_cmp": o(Q().group("o_custkey").metrics(rows).having(GTE(OUT("rows"), 15)), "select o_custkey, count(*) as rows from ORDERS group by 1 having count(*) >= 15"),
        "having_in": o(Q().group("o_custkey").metrics(rows).having(IN(OUT("rows"), [3, 5.0, 7.5])), "select o_custkey, count(*) as rows from ORDERS group by 1 having count(*) in (3, 5)"),
        "having_null": o(Q().group("status").metrics(rows).having(OR(ISNULL(OUT("status")), EQ(OUT("status"), "O"))), "select status, count(*) as rows from ORDERS group by 1 having status is null or status = 'O'"),
        "having_exists": o(Q().group("status").metrics(rows).having(EXISTS(OUT("status"))), "select status, count(*) as rows from ORDERS group by 1 having status is not null"),
        "having_not": o(Q().group("status").metrics(rows).having(NOT(EQ(OUT("status"), "O"))), "select status, count(*) as rows from ORDERS group by 1 having status is distinct from 'O'"),
        "having_int_vs_float": o(Q().group("o_custkey").metrics(rows).having(AND(GT(OUT("rows"), 9.5), LT(OUT("rows"), 1e30))), "select o_custkey, count(*) as rows from ORDERS group by 1 having count(*) >= 10"),
        "order_multi": o(Q().group("o_custkey", "status").metrics(rows).sort_out("rows", DESC).sort_out("status", DESC).limit(40), "select o_custkey, status, count(*) as rows from ORDERS group by 1, 2 order by rows desc, status desc nulls last, o_custkey limit 40"),
        "order_limit": o(Q().group("o_custkey").metrics(rows).sort_out("rows", DESC).limit(10), "select o_custkey, count(*) as rows from ORDERS group by 1 order by rows desc, o_custkey limit 10"),
        "agg_window": o(Q().group("o_custkey").metrics(rows).offset(10).limit(10), "select o_custkey, count(*) as rows from ORDERS group by 1 order by 1 limit 10 offset 10"),
        "mixed_metrics": c(
            query(GT("c_acctbal", 0)).group("c_mktsegment").metrics(rows, COUNT("balance").AS("n"), SUM("balance").AS("s"), AVG("balance").AS("a"), MIN("c_nationkey").AS("lo"), MAX("c_name").AS("hi"), COUNT(DISTINCT("c_nationkey")).AS("d")).having(GT(OUT("s"), 0)).sort_out("s", DESC).sort_out("c_mktsegment", ASC),
            "select c_mktsegment, count(*) as rows, count(balance) as n, cast(sum(balance) as bigint) as s, avg(balance) as a, min(c_nationkey) as lo, max(c_name) as hi, count(distinct c_nationkey) as d from CUSTOMER where c_acctbal > 0 group by 1 having sum(balance) > 0",
        ),
        "measure_by_group": (
            lambda s, d: lineitem(s, d).aggregate(Q().group("l_returnflag", "l_linestatus").metrics(SUM("l_extendedprice").AS("v"), rows)).withColumn("v", F.round("v", 2)),
            f"select l_returnflag, l_linestatus, {price} as v, count(*) as rows from lineitem group by 1, 2",
        ),
    }


def _with_flag(spark: SparkSession, sf_dir: str) -> Collection:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("big", F.col("o_totalprice") > 100)
    return Collection(df, Schema.of(df, "o_orderkey", "orders"))


def _got(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = customer(spark, sf_dir)
    found = [(key, people.get(key)) for key in (7, 1, 10**9, -5)]
    return spark.createDataFrame([(key, row is not None, row and row["c_name"]) for key, row in found], "asked long, found boolean, c_name string")


def _metadata() -> dict[str, tuple[Build, str]]:
    fields = ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    size = {"c_name": "strlen(c_name)", "c_mktsegment": "strlen(c_mktsegment)"}
    listed = " union all ".join(f"select '{f}' as field, cast({f} as varchar) as value, {size.get(f, 8)} as bytes from customer where {f} is not null" for f in fields)
    counts = f"(select field, value, bytes, count(*) as n from ({listed}) group by 1, 2, 3)"
    balance = "select 'balance' as field, count(*) as n from (select balance from CUSTOMER)".replace("CUSTOMER", _CUSTOMER)
    counted = " union all ".join([*(f"select '{f}' as field, count({f}) as records from customer" for f in fields), balance.replace("count(*) as n", "count(balance) as records")])
    return {
        "stats": (lambda s, d: customer(s, d).stats(), "select count(*) as keys, max(c_custkey) as last_key from customer"),
        "field_counts": (lambda s, d: customer(s, d).field_counts(), counted),
        "index_stats": (
            lambda s, d: customer(s, d).index_stats(),
            f'select field, count(*) as "distinct", cast(sum(n) as bigint) as entries, cast(sum(bytes) as bigint) as bytes from {counts} group by 1',
        ),
        "planner_stats": (
            lambda s, d: customer(s, d).planner_stats(),
            f'select field, count(*) as "distinct", cast(sum(n) as bigint) as total, avg(n) as mean, max(n) as most, quantile_cont(n, 0.5)::double as p50, quantile_cont(n, 0.95)::double as p95 from {counts} group by 1',
        ),
        "planner_snapshot": (
            _snapshot,
            f'select field, count(*) as "distinct", max(n) as most, cast(2 as bigint) as refreshes, cast(1 as bigint) as behind from {counts} group by 1',
        ),
        "store_stats": (
            _store_stats,
            "select 'rows' as name, count(*) as value from customer union all select * from (values ('collections', 1), ('committed', 2), ('failed', 1), ('refused', 1), ('open_views', 1), ('sequence', 50)) v(name, value)",
        ),
        "trace": (
            _traced,
            f"select 'query' as read, (select count(*) from {_ORDERS} where o_orderstatus = 'O' and o_totalprice >= 100000) as rows, true as scanned, true as pushed union all select 'count', 1, true, false",
        ),
    }


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept statistics after a refresh, a commit, a refresh and another commit: those of the second refresh."""
    handle = _stored(spark, sf_dir)
    handle.refresh_planner_stats()
    with handle.store.update() as tx:
        handle.patch(tx, 1, {"c_mktsegment": "OTHER"})
        handle.patch(tx, 1, {"c_mktsegment": handle.latest().get(1)["c_mktsegment"]})
    handle.refresh_planner_stats()
    with handle.store.update() as tx:
        handle.delete(tx, 1)
    epoch, table = handle.planner_snapshot()
    refreshes = len(handle.store.files.folders("stats/customer"))
    behind = handle.store.manifest["epoch"] - epoch
    return table.select("field", "distinct", "most", F.lit(refreshes).cast("long").alias("refreshes"), F.lit(behind).cast("long").alias("behind"))


def _store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters after two commits, a failed and a refused one, with a view open and ids advanced to 50."""
    handle = _stored(spark, sf_dir)
    store = handle.store
    view = store.view()
    taken = handle.latest().get(2)["c_name"]
    for changes in ({"c_mktsegment": "A"}, {"c_mktsegment": "B"}, {"c_name": taken}):
        tx = store.update()
        handle.patch(tx, 1, changes)
        store.commit_batch([tx])
    handle.advance_id(50)
    Store(spark, store.files.root).collection(handle.schema).advance_id(10**6)
    _error(handle.truncate)
    counted = {**store.stats(), "sequence": handle.stats()["sequence"]}
    view.close()
    return spark.createDataFrame([(k, counted[k]) for k in ("rows", "collections", "committed", "failed", "refused", "open_views", "sequence")], "name string, value long")


def _traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, base = [], orders(spark, sf_dir)
    tracer = Tracer(events.append)
    tracer.write("query", base.query(query(EQ("o_orderstatus", "O"), GTE("o_totalprice", 100000))), f"{_folder(spark)}/trace-{uuid.uuid4().hex}")
    tracer.collect("count", base.count_of())
    return spark.createDataFrame([(e.read, e.rows, "Scan" in e.operators or any("Scan" in o for o in e.operators), bool(e.pushed)) for e in events], "read string, rows long, scanned boolean, pushed boolean")


def _error(call: Callable[[], object]) -> str:
    """The name of the error that a call raises, or 'none'."""
    try:
        call()
    except QuarryError as error:
        return type(error).__name__
    return "none"


def _cases(cases: Callable[[SparkSession, str], dict[str, str]], expected: dict[str, str]) -> tuple[Build, str]:
    """A table of cases and their outcomes."""
    build = lambda spark, sf_dir: spark.createDataFrame(list(cases(spark, sf_dir).items()), "case string, outcome string")
    return build, "select * from (values " + ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in expected.items()) + ') v("case", outcome)'


def _refusals() -> dict[str, tuple[Build, str]]:
    rows = ROWCOUNT().AS("rows")

    def reads(expected: str, **asked: Callable[[Collection], object]) -> tuple[Build, str]:
        return _cases(lambda s, d: {name: _error(lambda call=call: call(customer(s, d))) for name, call in asked.items()}, dict.fromkeys(asked, expected) | {"control": "none"} if "control" in asked else dict.fromkeys(asked, expected))

    refused = lambda **asked: reads("InvalidQuery", **asked, control=lambda c: c.query(query(EQ("c_nationkey", 1)).sort("c_name")))
    reduced = lambda q: lambda c: c.aggregate(q)
    return {
        "refuse_pos_literal": refused(text=lambda c: c.query(query().sort_by(POS("c_mktsegment", "BUILDING"))), key=lambda c: c.query(query().sort_by(POS(KEY, [1])))),
        "refuse_two_sort_keys": refused(two=lambda c: c.query(query().sort("c_name").sort("c_nationkey")), out=lambda c: c.query(query().sort_out("c_name"))),
        "refuse_having_in_empty": refused(empty=reduced(aggregate(rows).having(IN(OUT("rows"), []))), prefix=reduced(aggregate(rows).having(PREFIX(OUT("rows"), "1")))),
        "refuse_group_key": refused(group=reduced(Q().group(KEY)), total=reduced(aggregate(SUM(KEY)))),
        "refuse_measure_use": refused(group=reduced(Q().group("balance").metrics(rows)), distinct=reduced(aggregate(DISTINCT("balance"))), filter=lambda c: c.query(query(EQ("balance", 1)))),
        "refuse_aggregate_projection": refused(select=reduced(aggregate(rows).select("c_name")), name=reduced(aggregate(ROWCOUNT(), ROWCOUNT()))),
        "refuse_array_metrics": _cases(
            lambda s, d: {name: _error(lambda q=q: part(s, d).aggregate(q)) for name, q in {"avg": aggregate(AVG("tags")), "max": aggregate(MAX("tags")), "group": Q().group("tags"), "distinct": aggregate(DISTINCT("tags"))}.items()},
            dict.fromkeys(("avg", "max", "group", "distinct"), "InvalidQuery"),
        ),
        "errors": _cases(_misuse, {"nil value": "NilValue", "key of another kind": "InvalidKey", "over": "TransactionDone", "no transaction": "NilTransaction", "a view to write": "WrongTransaction", "another store": "StoreMismatch", "name": "InvalidName", "unique": "UniqueViolation", "closed": "Closed"}),
        "value_conversion": _cases(_converted, {"3.0 as int": "3", "3 as float": "3.0", "too wide": "InvalidPatch", "fraction": "InvalidPatch", "text as int": "InvalidPatch", "bool as int": "InvalidPatch", "negative unsigned": "InvalidPatch", "null": "None", "null where needed": "InvalidPatch", "list": "[1, None]", "no list": "InvalidPatch"}),
        "make_patch": _cases(_differences, {"equal": "{}", "signed zero": "{}", "one field": "{'a': 2}", "json name": "{'eMail': 'z'}", "no old": "{'a': 1, 'email': None}", "no new": "{}", "no name": "InvalidPatch"}),
        "next_id": _cases(_ids, {"first": "1,2,3", "advanced": "11", "not lowered": "12", "node": str(2 << 48 | 13), "after truncate": "14", "reopened is above": "True", "text keys ascend": "True"}),
    }


def _misuse(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    c = _stored(spark, sf_dir)
    store, done = c.store, c.store.update()
    done.close()
    other = Store(spark, f"{_folder(spark)}/store-{uuid.uuid4().hex}")

    def taken():
        with store.update() as tx:
            c.patch(tx, 1, {"c_name": c.latest().get(2)["c_name"]})

    found = {
        "nil value": _error(lambda: c.set(store.update(), 1, None)), "key of another kind": _error(lambda: c.set(store.update(), "a", {})), "over": _error(lambda: c.delete(done, 1)), "no transaction": _error(lambda: c.delete(None, 1)),
        "a view to write": _error(lambda: c.delete(store.view(), 1)), "another store": _error(lambda: c.delete(other.update(), 1)), "name": _error(lambda: store.collection(Schema("a/b", "id", "int64", c.schema.fields))), "unique": _error(taken),
    }
    store.close()
    return found | {"closed": _error(store.view)}


def _said(call: Callable[[], object]) -> str:
    try:
        return str(call())
    except QuarryError as error:
        return type(error).__name__


def _converted(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    whole, half = Field("a", "int32"), Field("b", "float64")
    asked = {
        "3.0 as int": (3.0, whole), "3 as float": (3, half), "too wide": (2**31, whole), "fraction": (1.5, whole), "text as int": ("1", whole), "bool as int": (True, whole), "negative unsigned": (-1, Field("u", "uint64")), "null": (None, whole),
        "null where needed": (None, Field("n", "int64", nullable=False)), "list": ([1, None], Field("l", "int64", array=True)), "no list": ("x", Field("l", "string", array=True)),
    }
    return {name: _said(lambda v=v, f=f: convert(v, f)) for name, (v, f) in asked.items()}


def _differences(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    schema = Schema("s", "id", "int64", (Field("a", "float64"), Field("email", "string", json="eMail")))
    nameless, old = Schema("s", "id", "int64", (Field("a", "int64", json="-"),)), {"a": 0.0, "email": None}
    return {
        "equal": _said(lambda: make_patch(schema, old, old)), "signed zero": _said(lambda: make_patch(schema, old, {**old, "a": -0.0})), "one field": _said(lambda: make_patch(schema, old, {**old, "a": 2})),
        "json name": _said(lambda: make_patch(schema, old, {**old, "email": "z"}, json=True)).replace('"', "'"), "no old": _said(lambda: make_patch(schema, None, {"a": 1, "email": None})), "no new": _said(lambda: make_patch(schema, old, None)),
        "no name": _said(lambda: make_patch(nameless, None, {"a": 1}, json=True)),
    }


def _ids(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    store = Store(spark, f"{_folder(spark)}/store-{uuid.uuid4().hex}")
    users, pages = Schema("users", "id", "int64", (Field("a", "int64"),)), Schema("pages", "url", "string", (Field("a", "int64"),))
    numbered, named = store.collection(users), store.collection(pages)
    found = {"first": ",".join(str(numbered.next_id()) for _ in range(3))}
    numbered.advance_id(10)
    found["advanced"] = str(numbered.next_id())
    numbered.advance_id(5)
    found["not lowered"], found["node"] = str(numbered.next_id()), str(numbered.next_id(node=2))
    numbered.truncate()
    found["after truncate"] = str(numbered.next_id())
    found["reopened is above"] = str(Store(spark, store.files.root).collection(users).next_id() > 14)
    made = [named.next_id() for _ in range(20)]
    return found | {"text keys ascend": str(made == sorted(set(made)))}


def _folder(spark: SparkSession) -> str:
    """The shared folder; one of our own only where the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return root or f"file://{tempfile.mkdtemp(prefix='quarry-store-')}"


def _stored(spark: SparkSession, sf_dir: str) -> StoredCollection:
    """The customers in a store of their own, in the shared folder if the session names one."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    handle = Store(spark, f"{_folder(spark)}/store-{uuid.uuid4().hex}", buckets=4).collection(Schema.of(df, "c_custkey", "customer", unique=["c_name"]))
    handle.load(df)
    return handle


def _written(change: Callable[[StoredCollection], None]) -> Build:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        handle = _stored(spark, sf_dir)
        change(handle)
        return handle.latest().scan()

    return build


def _writes() -> dict[str, tuple[Build, str]]:
    new = {"c_name": "new", "c_nationkey": 3, "c_acctbal": 1.5, "c_mktsegment": "NONE"}

    def upsert(c):
        with c.store.update() as tx:
            c.set(tx, 1, new)
            c.set(tx, 10**9, {**new, "c_name": "newer"})

    def patch(c):
        with c.store.update() as tx:
            for key in range(1, 51):
                c.patch(tx, key, {"c_mktsegment": "X", "unknown": 1})

    def delete(c):
        with c.store.update() as tx:
            for key in (*range(1, 11), 10**9):
                c.delete(tx, key)

    def swap(c):
        now = {k: c.latest().get(k)["c_name"] for k in (1, 2)}
        with c.store.update() as tx:
            c.patch(tx, 1, {"c_name": now[2]})
            c.patch(tx, 2, {"c_name": now[1]})

    def aliases(c):
        other = c.store.collection(replace(c.schema, fields=tuple(replace(f, aliases=("segment",), json="Seg") if f.name == "c_mktsegment" else f for f in c.schema.fields)))
        with c.store.update() as tx:
            other.patch(tx, 1, {"segment": "BY ALIAS"})
            other.patch(tx, 2, {"Seg": "BY JSON"})
            other.patch(tx, 3, {"segment": "FIRST", "c_mktsegment": "LAST"})

    def hooked(c):
        def hook(tx, key, old, now):  # mark what changes, and keep what it was under another key
            if key < 10**6 and now is not None:
                now["c_mktsegment"] = "HOOKED"
                keep.set(tx, key + 10**6, {**old, "c_name": f"old {old['c_name']}"})

        keep = c.store.collection(c.schema, hooks=[hook])
        with c.store.update() as tx:
            for key in (1, 2, 3):
                keep.patch(tx, key, {"c_nationkey": 0})
            keep.delete(tx, 4)

    def strict(c):
        for key, changes in ((1, {"c_mktsegment": "NO", "unknown": 1}), (2, {"c_mktsegment": "YES"})):
            tx = c.store.update()
            c.patch(tx, key, changes, strict=True)
            c.store.commit_batch([tx])

    def batched(c):
        taken = c.latest().get(2)["c_name"]
        with c.store.batch(soft_limit=2) as batch:
            for key, changes in ((1, {"c_mktsegment": "B"}), (3, {"c_name": taken}), (5, {"c_mktsegment": "B"}), (6, {"c_nationkey": "x"}), (7, {"c_mktsegment": "B"})):
                tx = c.store.update()
                c.patch(tx, key, changes)
                batch.submit(tx)

    def refused(c):
        late = Store(c.store.spark, c.store.files.root)
        ours, theirs, behind = c.store.update(), late.update(), late.collection(c.schema)
        c.patch(ours, 1, {"c_mktsegment": "FIRST"})
        behind.patch(theirs, 1, {"c_mktsegment": "LATE"})
        behind.patch(theirs, 2, {"c_mktsegment": "LATE"})
        ours.commit()
        assert _error(theirs.commit) == "StaleManifest"
        late.refresh()
        with late.update() as tx:
            behind.patch(tx, 3, {"c_mktsegment": "RETRIED"})
        late.vacuum()
        c.store.refresh()

    def merged(c):
        c.merge(c.latest().scan(5).where("c_custkey < 9").withColumn("c_mktsegment", F.lit("MERGED")))

    def evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = _stored(spark, sf_dir)
        fields = tuple(replace(f, kind="int64") if f.name == "c_nationkey" else f for f in c.schema.fields if f.name != "c_acctbal")
        now = c.store.collection(replace(c.schema, fields=(*fields, Field("city", "string"))))
        with c.store.update() as tx:
            now.patch(tx, 1, {"city": "X", "c_nationkey": 2**40})
        return now.latest().scan()

    segment = "select c_custkey, c_name, c_nationkey, c_acctbal, {} as c_mktsegment from customer".format
    rest = "c_nationkey, c_acctbal, c_mktsegment from customer"
    return {
        "set_upsert": (_written(upsert), "select * from customer where c_custkey <> 1 union all select k, n, 3, 1.5, 'NONE' from (values (1, 'new'), (1000000000, 'newer')) v(k, n)"),
        "patch": (_written(patch), "select c_custkey, c_name, c_nationkey, c_acctbal, case when c_custkey between 1 and 50 then 'X' else c_mktsegment end as c_mktsegment from customer"),
        "delete": (_written(delete), "select * from customer where c_custkey not between 1 and 10"),
        "patch_by_alias": (_written(aliases), segment("case c_custkey when 1 then 'BY ALIAS' when 2 then 'BY JSON' when 3 then 'LAST' else c_mktsegment end")),
        "hooks": (_written(hooked), "select c_custkey, c_name, case when c_custkey between 1 and 3 then 0 else c_nationkey end as c_nationkey, c_acctbal, case when c_custkey between 1 and 3 then 'HOOKED' else c_mktsegment end as c_mktsegment from customer where c_custkey <> 4 union all select c_custkey + 1000000, 'old ' || c_name, c_nationkey, c_acctbal, c_mktsegment from customer where c_custkey between 1 and 3"),
        "patch_strict": (_written(strict), segment("case c_custkey when 2 then 'YES' else c_mktsegment end")),
        "batch": (_written(batched), segment("case when c_custkey in (1, 5, 7) then 'B' else c_mktsegment end")),
        "refused_writer": (_written(refused), segment("case c_custkey when 1 then 'FIRST' when 3 then 'RETRIED' else c_mktsegment end")),
        "merge": (_written(merged), segment("case when c_custkey between 5 and 8 then 'MERGED' else c_mktsegment end")),
        "schema_evolution": (evolved, "select c_custkey, c_name, case when c_custkey = 1 then 1099511627776 else c_nationkey end as c_nationkey, c_mktsegment, case when c_custkey = 1 then 'X' end as city from customer"),
        "truncate": (_written(lambda c: c.truncate()), "select * from customer where false"),
        "unique_swap": (_written(swap), f"select c_custkey, case c_custkey when 1 then (select c_name from customer where c_custkey = 2) when 2 then (select c_name from customer where c_custkey = 1) else c_name end as c_name, {rest}"),
    }


def _all() -> dict[str, tuple[Build, str]]:
    return _orderings() | _filters() | _aggregates() | _metadata() | _refusals() | _writes()


def queries() -> dict[str, Build]:
    return {name: build for name, (build, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items()}
