"""Queries of the driver contract, one or more for each operator, and the SQL that checks them.

The given tables are clean, so operators on dirty values read views of them that are made dirty by
arithmetic which both engines share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe import pipeline
from tallyframe.functions import scalars
from tallyframe.functions.names import canonical, key
from tallyframe.operators import anomalies, cleaning, forecast, kgraph, patterns, profile
from tallyframe.plans.cleaning_plan import CleaningPlan, Fill, heuristic_plan
from tallyframe.session import shared_path
from tallyframe.sources import readers, sinks
from tallyframe.streaming import trends

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- profiles -----------------------------------------------------------------------------------


def _profile_sql(name: str, columns: list[str]) -> str:
    parts = [
        f"select '{c}' as column_name, count(*)::bigint as row_count, count(*) filter (where {c} is null)::bigint as null_count, "
        f"round(100.0 * count(*) filter (where {c} is null) / count(*), 2)::double as null_pct, "
        f"(count(distinct {c}) + max(case when {c} is null then 1 else 0 end))::bigint as n_unique from {name}"
        for c in columns
    ]
    return " union all ".join(parts)


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(_profile_sql("orders", _ORDERS))
def profile_orders(spark, sf_dir):
    p = profile.column_profile(table(spark, sf_dir, "orders"))
    return p.select(F.col("column").alias("column_name"), "row_count", "null_count", "null_pct", "n_unique")


_KEYS_SQL = """
with p as ({profile}),
r as (select column_name, case when regexp_matches(replace(trim(column_name), ' ', '_'), '^(id|.*_id|.*_key|key|.*_code|code|sku|.*_ref|ref|.*_number)$', 'i') then 0
  when n_unique / row_count::double >= 0.95 and n_unique > 1 then 2
  when n_unique / row_count::double >= 0.85 and n_unique > 1 and contains(lower(column_name), 'id') then 1 end as key_rank, null_pct from p)
select column_name, key_rank from r where key_rank is not null and null_pct <= 50
"""


@query(_KEYS_SQL.format(profile=_profile_sql("customer", _CUSTOMER)))
def join_key_candidates(spark, sf_dir):
    found = profile.join_key_candidates(profile.column_profile(table(spark, sf_dir, "customer")))
    return found.select(F.col("column").alias("column_name"), F.col("rank").alias("key_rank"))


@query("select * from nation order by n_nationkey limit 20")
def sample_head(spark, sf_dir):
    return profile.head(table(spark, sf_dir, "nation").withColumn("_row_id", F.col("n_nationkey")), 20).drop("_row_id")


# --- projections and casts ----------------------------------------------------------------------


@query("select p_partkey as part_key, p_name as part_name, p_size as size_of_part from part")
def rename_normalise(spark, sf_dir):
    messy = table(spark, sf_dir, "part").select(F.col("p_partkey").alias(" Part  Key"), F.col("p_name").alias("PART name"), F.col("p_size").alias("Size of\tPart "))
    return cleaning.rename(messy, {c: canonical(c) for c in messy.columns})


@query(r"""
select o_orderkey, try_cast(trim(regexp_replace(t, '[$,]', '', 'g')) as double) as amount from (
  select o_orderkey, case when o_orderkey % 7 = 0 then 'n/a' when o_orderkey % 5 = 0 then null
    else ' $' || cast(cast(floor(o_totalprice) as bigint) // 1000 as varchar) || ',' || lpad(cast(cast(floor(o_totalprice) as bigint) % 1000 as varchar), 3, '0') || ' ' end as t from orders)
""")
def currency_strip(spark, sf_dir):
    whole = F.expr("cast(floor(o_totalprice) as bigint)")
    text = F.expr(
        "case when o_orderkey % 7 = 0 then 'n/a' when o_orderkey % 5 = 0 then null else concat(' $', cast(p div 1000 as string), ',', lpad(cast(p % 1000 as string), 3, '0'), ' ') end"
    )
    dirty = table(spark, sf_dir, "orders").withColumn("p", whole).select("o_orderkey", text.alias("amount"))
    return cleaning.strip_currency(dirty, ("amount",))


_DIRTY_DATE = """case o_orderkey % 6 when 0 then {iso} when 1 then {dmy} when 2 then {dash} when 3 then concat(' ', {iso}, ' ') when 4 then 'soon' else null end"""


@query("""
select o_orderkey, coalesce(try_strptime(trim(t), '%Y-%m-%d'), try_strptime(trim(t), '%d/%m/%Y'), try_strptime(trim(t), '%m/%d/%Y'), try_strptime(trim(t), '%d-%m-%Y'), try_strptime(trim(t), '%m-%d-%Y'))::date as order_date
from (select o_orderkey, """ + _DIRTY_DATE.format(iso="strftime(o_orderdate, '%Y-%m-%d')", dmy="strftime(o_orderdate, '%d/%m/%Y')", dash="strftime(o_orderdate, '%d-%m-%Y')") + """ as t from orders)
""")
def date_multi_format(spark, sf_dir):
    text = _DIRTY_DATE.format(iso="date_format(o_orderdate, 'yyyy-MM-dd')", dmy="date_format(o_orderdate, 'dd/MM/yyyy')", dash="date_format(o_orderdate, 'dd-MM-yyyy')")
    dirty = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(text).alias("order_date"))
    return cleaning.parse_dates(dirty, (cleaning.DateParser("order_date"),))


@query("""
select o_orderkey, try_cast(a as bigint) as as_int, try_cast(a as double) as as_float, try_cast(b as boolean) as as_bool, cast(o_custkey as varchar) as as_text, try_strptime(d, '%Y-%m-%d')::date as as_date
from (select *, case when o_orderkey % 3 = 0 then 'x' else cast(o_custkey as varchar) end as a, case when o_orderkey % 2 = 0 then 'true' when o_orderkey % 5 = 0 then 'maybe' else 'false' end as b,
  case when o_orderkey % 4 = 0 then 'never' else strftime(o_orderdate, '%Y-%m-%d') end as d from orders)
""")
def dtype_fix(spark, sf_dir):
    dirty = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "case when o_orderkey % 3 = 0 then 'x' else cast(o_custkey as string) end as as_int", "case when o_orderkey % 3 = 0 then 'x' else cast(o_custkey as string) end as as_float",
        "case when o_orderkey % 2 = 0 then 'true' when o_orderkey % 5 = 0 then 'maybe' else 'false' end as as_bool", "o_custkey as as_text",
        "case when o_orderkey % 4 = 0 then 'never' else date_format(o_orderdate, 'yyyy-MM-dd') end as as_date",
    )
    return cleaning.fix_dtypes(dirty, {"as_int": "int", "as_float": "float", "as_bool": "boolean", "as_text": "string", "as_date": "date"})


@query("select o_orderkey, length(o_orderpriority)::int as n_chars, date_trunc('week', o_orderdate)::date as week from orders")
def text_length_and_week(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.length(F.col("o_orderpriority")).alias("n_chars"), scalars.week(F.col("o_orderdate")).alias("week"))


@query(r"""
select p_partkey, 'p_name:' || substr(regexp_replace(trim(p_name), '[^\w.-]+', '_', 'g'), 1, 64) as node,
  case when p_retailprice >= 1500 then 'high' else 'low' end as price_class from part
""")
def graph_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.graph_id("p_name", F.col("p_name")).alias("node"), F.when(F.col("p_retailprice") >= 1500, "high").otherwise("low").alias("price_class"))


@query("""
select score, case when score >= 0.85 then 'critical' when score >= 0.65 then 'high' when score >= 0.4 then 'medium' else 'low' end as severity,
  case when score >= 1.0 or abs(lift) >= 30 then 'high' when score < 0.15 then 'low' else 'medium' end as impact,
  case when lift > 5 then 'up' when lift < -5 then 'down' else 'flat' end as direction, n
from (select l_discount * 10 as score, l_quantity - 25 as lift, count(*)::bigint as n from lineitem group by 1, 2)
""")
def buckets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_discount") * 10).alias("score"), (F.col("l_quantity") - 25).alias("lift")).agg(F.count("*").alias("n"))
    return rows.select("score", scalars.severity(F.col("score")).alias("severity"), scalars.impact(F.col("score"), F.col("lift")).alias("impact"), scalars.direction(F.col("lift")).alias("direction"), "n")


# --- fills --------------------------------------------------------------------------------------

_HOLES = "select o_orderkey, case when o_orderkey % 5 = 0 then null else o_totalprice end as price, case when o_orderkey % 7 = 0 then null else o_orderpriority end as priority from orders"


def _holes(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "case when o_orderkey % 5 = 0 then null else o_totalprice end as price", "case when o_orderkey % 7 = 0 then null else o_orderpriority end as priority"
    )


def _fill(name: str, fills: tuple[Fill, ...], columns: str, source: str = "h"):
    def run(spark, sf_dir):
        out = cleaning.fill_nulls(_holes(spark, sf_dir), fills)
        return out.withColumn("price", F.round("price", 4))

    QUERIES[name] = run
    ORACLES[name] = f"with h as ({_HOLES}) select {columns} from {source}"


_fill("fill_zero", (Fill("price", "zero"),), "o_orderkey, round(coalesce(price, 0), 4) as price, priority")
_fill("fill_mean", (Fill("price", "mean"),), "o_orderkey, round(coalesce(price, (select avg(price) from h)), 4) as price, priority")
_fill("fill_median", (Fill("price", "median"),), "o_orderkey, round(coalesce(price, (select median(price) from h)), 4) as price, priority")
_fill(
    "fill_mode", (Fill("priority", "mode"),),
    "o_orderkey, round(price, 4) as price, coalesce(priority, (select priority from h where priority is not null group by priority order by count(*) desc, priority limit 1)) as priority",
)
_fill("fill_constant", (Fill("priority", "constant", "unknown"),), "o_orderkey, round(price, 4) as price, coalesce(priority, 'unknown') as priority")
_fill("fill_drop", (Fill("price", "drop"),), "o_orderkey, round(price, 4) as price, priority", "h where price is not null")
_fill(
    "fill_drop_then_mean", (Fill("priority", "drop"), Fill("price", "mean")),
    "o_orderkey, round(coalesce(price, (select avg(price) from h where priority is not null)), 4) as price, priority", "h where priority is not null",
)


@query("""
with h as (select event_id, case when event_id % 3 = 0 then value when event_id % 3 = 1 then null else null end as value from events)
select event_id, last_value(value ignore nulls) over (order by event_id rows between unbounded preceding and current row) as value from h
""")
def forward_fill(spark, sf_dir):
    dirty = table(spark, sf_dir, "events").selectExpr("event_id", "case when event_id % 3 = 0 then value else null end as value")
    return cleaning.forward_fill(dirty, "value", "event_id")


# --- dedup, joins, unions -----------------------------------------------------------------------


@query("""
select l_orderkey, l_linenumber, l_partkey, l_quantity from (
  select *, row_number() over (partition by l_orderkey order by l_linenumber desc, l_partkey desc, l_quantity desc) as n from lineitem) where n = 1
""")
def dedup_keep_last(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.struct("l_linenumber", "l_partkey", "l_quantity").alias("_place"))
    return cleaning.dedup_keep_last(rows, ("l_orderkey",), "_place").drop("_place")


@query("select count(*)::bigint as rows, count(distinct (l_orderkey, l_linenumber))::bigint as unique_rows, round(1 - count(distinct (l_orderkey, l_linenumber)) / count(*)::double, 4) as duplicate_rate from lineitem")
def duplicate_rate(spark, sf_dir):
    return cleaning.duplicate_rate(table(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber"))


@query("""
select c.c_custkey, c.nation_key, c.name, n.name as "name_nation.csv", n.region_key, r.name as "name_region.csv"
from (select c_custkey, c_nationkey as nation_key, c_name as name from customer) c
left join (select n_nationkey as nation_key, n_name as name, n_regionkey as region_key from nation) n using (nation_key)
left join (select r_regionkey as region_key, r_name as name from region) r on n.region_key = r.region_key
""")
def left_join_multi(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey as nation_key", "c_name as name")
    nation = table(spark, sf_dir, "nation").selectExpr("n_nationkey as nation_key", "n_name as name", "n_regionkey as region_key")
    region = table(spark, sf_dir, "region").selectExpr("r_regionkey as region_key", "r_name as name")
    one = cleaning.join_left(customer, nation, ["nation_key"], "_nation.csv")
    return cleaning.join_left(one, region, ["region_key"], "_region.csv")


@query("""
select c_custkey as id, c_name as name, cast(c_acctbal as varchar) is not null as has_balance, c_mktsegment as segment, null as rank from customer
union all select s_suppkey, s_name, cast(s_acctbal as varchar) is not null, null, s_nationkey from supplier
""")
def union_diagonal(spark, sf_dir):
    a = table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_name as name", "c_acctbal is not null as has_balance", "c_mktsegment as segment")
    b = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "s_name as name", "s_acctbal is not null as has_balance", "s_nationkey as rank")
    return cleaning.union_diagonal([a, b])


@query("""
with u as (select cast(c_custkey as varchar) as k, c_acctbal as v from customer union all select s_name, s_acctbal from supplier)
select k, round(sum(v), 2) as v from u group by k
""")
def union_mixed_types(spark, sf_dir):
    a = table(spark, sf_dir, "customer").selectExpr("c_custkey as k", "c_acctbal as v")
    b = table(spark, sf_dir, "supplier").selectExpr("s_name as k", "s_acctbal as v")
    return cleaning.union_diagonal([a, b]).groupBy("k").agg(F.round(F.sum("v"), 2).alias("v"))


@query("""
with d as (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as n from orders)
select (select count(*) from orders)::bigint as rows_before, count(*)::bigint as rows_after, 0.0::double as duplicate_rate,
  (select round(1 - count(distinct o_custkey) / count(*)::double, 4) from orders) as duplicate_rate_before, true as passed, 'OK' as message from d where n = 1
""")
def validate_report(spark, sf_dir):
    plan = CleaningPlan(dedup_keys=("o_custkey",), required=("o_orderkey",))
    rows = table(spark, sf_dir, "orders")
    v = cleaning.validate(cleaning.dedup_keep_last(rows, plan.dedup_keys, "o_orderkey"), plan, before=rows)
    return spark.createDataFrame(
        [(v.rows_before, v.rows_after, v.duplicate_rate, v.duplicate_rate_before, v.passed, v.message)],
        "rows_before long, rows_after long, duplicate_rate double, duplicate_rate_before double, passed boolean, message string",
    )


# --- patterns -----------------------------------------------------------------------------------

_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" union all ".join(f"select '{c}' as column_name, round(avg({c}), 4) as avg, round(min({c}), 4) as min, round(max({c}), 4) as max from lineitem" for c in _NUMBERS))
def numeric_summary(spark, sf_dir):
    return patterns.numeric_summary(table(spark, sf_dir, "lineitem"), _NUMBERS).withColumnRenamed("column", "column_name")


_CORR = " union all ".join(f"select '{a}' as column_a, '{b}' as column_b, corr({a}, {b}) as r from lineitem" for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :])


@query(f"select column_a, column_b, round(r, 4) as correlation from ({_CORR})")
def correlations_all(spark, sf_dir):
    return patterns.correlation_matrix(table(spark, sf_dir, "lineitem"), _NUMBERS).select("column_a", "column_b", F.round("correlation", 4).alias("correlation"))


_MIXED = "(select l_quantity, l_extendedprice, l_discount, l_quantity * 40 + l_discount * 10000 as mixed, 1000 - l_quantity as falling from lineitem)"
_MIXED_CORR = " union all ".join(
    f"select '{a}' as column_a, '{b}' as column_b, corr({a}, {b}) as r from {_MIXED}" for a, b in combinations(["l_quantity", "l_extendedprice", "l_discount", "mixed", "falling"], 2)
)


@query(f"select column_a, column_b, round(r, 4) as correlation, round(abs(r), 4) as score, case when r > 0 then 'positive' else 'negative' end as direction from ({_MIXED_CORR}) where abs(r) >= 0.3")
def correlations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_quantity", "l_extendedprice", "l_discount", "l_quantity * 40 + l_discount * 10000 as mixed", "1000 - l_quantity as falling")
    return patterns.correlations(rows).drop("seq")


def _sales(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select("c_mktsegment", "o_orderpriority", "o_orderstatus", "o_totalprice", "c_acctbal")


_SALES = "(select c_mktsegment, o_orderpriority, o_orderstatus, o_totalprice, c_acctbal from orders join customer on o_custkey = c_custkey)"
_LIFTS = " union all ".join(
    f"select '{c}' as segment_column, '{m}' as metric_column, {c} as segment_value, avg({m}) as mean, count(*)::bigint as n, (select avg({m}) from {_SALES}) as overall from {_SALES} group by {c}"
    for c in ("c_mktsegment", "o_orderpriority", "o_orderstatus")
    for m in ("o_totalprice", "c_acctbal")
)


@query(f"select segment_column, metric_column, segment_value, round(mean, 4) as segment_mean, n as count, round(overall, 4) as global_mean, round((mean / overall - 1) * 100, 4) as lift_pct from ({_LIFTS})")
def segment_lift_all(spark, sf_dir):
    found = patterns.segment_means(_sales(spark, sf_dir), ["c_mktsegment", "o_orderpriority", "o_orderstatus"], ["o_totalprice", "c_acctbal"])
    return found.select(
        "segment_column", "metric_column", "segment_value", F.round("segment_mean", 4).alias("segment_mean"), "count", F.round("global_mean", 4).alias("global_mean"),
        F.round(F.col("lift") * 100, 4).alias("lift_pct"),
    )


@query(f"""
with l as (select *, mean / overall - 1 as lift from ({_LIFTS})),
m as (select *, max(abs(lift)) over (partition by segment_column, metric_column) as far from l),
b as (select *, row_number() over (partition by segment_column, metric_column order by mean desc) as k from m where abs(abs(lift) - far) <= greatest(1e-6, 1e-6 * far))
select segment_column, metric_column, segment_value, round(mean, 4) as segment_mean, round(overall, 4) as global_mean, round(lift * 100, 2) as lift_pct, n as count, round(least(abs(lift), 5.0), 4) as score
from b where k = 1 and abs(lift) >= 0.001
""")
def segment_lift_best(spark, sf_dir):
    return patterns.segment_lifts(_sales(spark, sf_dir), ["c_mktsegment", "o_orderpriority", "o_orderstatus"], ["o_totalprice", "c_acctbal"], least=0.001).drop("seq")


@query("select date_trunc('week', o_orderdate)::date as week, round(sum(o_totalprice), 2) as value, count(*)::bigint as rows from orders group by 1")
def weekly_trend(spark, sf_dir):
    return patterns.weekly(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice").withColumn("value", F.round("value", 2))


def _trend_sql(name: str, ts: str, value: str) -> str:
    return f"""
with w as (select date_trunc('week', {ts}) as week, sum({value}) as v from {name} group by 1),
e as (select count(*)::bigint as periods, arg_min(v, week) as a, arg_max(v, week) as b from w)
select '{ts}' as date_column, '{value}' as metric_column, periods, round(a, 4) as first_value, round(b, 4) as last_value, round((b - a) / a * 100, 2) as change_pct,
  case when (b - a) / a * 100 > 5 then 'up' when (b - a) / a * 100 < -5 then 'down' else 'flat' end as direction, round(least(abs((b - a) / a), 3.0), 4) as score from e"""


@query(_trend_sql("orders", "o_orderdate", "o_totalprice"))
def weekly_trend_summary(spark, sf_dir):
    return patterns.time_trend(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")


@query(_trend_sql("events", "ts", "value"))
def weekly_trend_events(spark, sf_dir):
    return patterns.time_trend(table(spark, sf_dir, "events"), "ts", "value")


@query("""
with c as (select o_orderstatus as a, o_orderpriority as b, count(*)::bigint as n, (select count(*) from orders) as total from orders group by 1, 2)
select 'o_orderstatus' as column_a, 'o_orderpriority' as column_b, a as value_a, b as value_b, n as count, round(n * 100.0 / total, 2)::double as share_pct, round(n / total::double, 4) as score
from c order by n desc, a, b limit 1
""")
def categorical_combos(spark, sf_dir):
    return patterns.categorical_combos(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"]).drop("seq")


_RISING = "(select o_orderstatus, o_orderpriority, o_orderdate, o_totalprice, o_totalprice * 2 + o_orderkey as doubled, case when o_orderstatus = 'F' then 3.0 else 1.0 end as part from orders)"
_RISING_LIFTS = " union all ".join(
    f"select '{c}' as c, '{m}' as m, max(abs(v / overall - 1)) as far from (select avg({m}) as v, (select avg({m}) from {_RISING}) as overall from {_RISING} group by {c})"
    for c in ("o_orderstatus", "o_orderpriority")
    for m in ("o_totalprice", "doubled", "part")
)
_RISING_CORR = " union all ".join(f"select corr({a}, {b}) as r from {_RISING}" for a, b in combinations(["o_totalprice", "doubled", "part"], 2))


@query(f"""
select 'correlation' as type, count(*)::int as count from ({_RISING_CORR}) where abs(r) >= 0.3
union all select 'segment_lift', count(*)::int from ({_RISING_LIFTS}) where far >= 0.05
union all select 'time_trend', (count(distinct date_trunc('week', o_orderdate)) >= 2)::int from orders
union all select 'categorical_combo', 1 where (select count(*) from orders) > 0
""")
def pattern_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice", "o_totalprice * 2 + o_orderkey as doubled", "case when o_orderstatus = 'F' then 3.0D else 1.0D end as part"
    )
    return patterns.pattern_counts(patterns.discover(rows)).withColumn("count", F.col("count").cast("int"))


@query(f"""
with t as (select date_trunc('week', o_orderdate) as week, sum(o_totalprice) as v from orders group by 1),
e as (select arg_min(v, week) as a, arg_max(v, week) as b from t),
c as (select o_orderstatus as a, o_orderpriority as b, count(*) as n, (select count(*) from orders) as total from orders group by 1, 2 order by 3 desc, 1, 2 limit 1),
g as (select c, m, arg_max(k, abs(v / o - 1)) as k, arg_max(v / o - 1, abs(v / o - 1)) as lift from (
  select 'o_orderstatus' as c, 'o_totalprice' as m, o_orderstatus as k, avg(o_totalprice) as v, (select avg(o_totalprice) from orders) as o from orders group by 3
  union all select 'o_orderpriority', 'o_totalprice', o_orderpriority, avg(o_totalprice), (select avg(o_totalprice) from orders) from orders group by 3
  union all select 'o_orderstatus', 'part', o_orderstatus, avg(part), (select avg(part) from {_RISING}) from {_RISING} group by 3
  union all select 'o_orderpriority', 'part', o_orderpriority, avg(part), (select avg(part) from {_RISING}) from {_RISING} group by 3) group by 1, 2),
all_of as (
  select 'o_totalprice over time: ' || case when (b - a) / a * 100 > 5 then 'up' when (b - a) / a * 100 < -5 then 'down' else 'flat' end as title, round(least(abs((b - a) / a), 3.0), 4) as score, null as lift from e
  union all select 'Usual pair of o_orderstatus and o_orderpriority', round(n / total::double, 4), null from c
  union all select m || ' differs for ' || c || ' ' || k, round(least(abs(lift), 5.0), 4), round(lift * 100, 2) from g where abs(lift) >= 0.05
  union all select 'o_totalprice goes with part', round(abs(r), 4), null from (select corr(o_totalprice, part) as r from {_RISING}) where abs(r) >= 0.3)
select title, case when score >= 1 or abs(coalesce(lift, 0)) >= 30 then 'high' when score < 0.15 then 'low' else 'medium' end as impact, score from all_of order by score desc limit 5
""")
def insight_ranking(spark, sf_dir):
    """All four kinds of patterns compete."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice", "case when o_orderstatus = 'F' then 3.0D else 1.0D end as part")
    return patterns.insight_cards(patterns.discover(rows)).select("title", "impact", "score")


# --- anomalies ----------------------------------------------------------------------------------


@query("""
with s as (select l_orderkey, l_linenumber, (l_quantity - avg(l_quantity) over ()) / stddev_pop(l_quantity) over () as a, (l_extendedprice - avg(l_extendedprice) over ()) / stddev_pop(l_extendedprice) over () as b from lineitem)
select l_orderkey, l_linenumber, round(greatest(abs(a), abs(b)), 4) as z, case when abs(a) >= abs(b) then 'l_quantity' else 'l_extendedprice' end as metric from s
""")
def feature_scale_zmax(spark, sf_dir):
    columns = ["l_quantity", "l_extendedprice"]
    rows, names = anomalies.scaled_features(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *columns), columns)
    return rows.select("l_orderkey", "l_linenumber", F.round(F.greatest(*[F.abs(n) for n in names]), 4).alias("z"), anomalies.widest_feature(names, columns).alias("metric"))


_TEXT_SQL = """
with n as (select {key} as row_index, {text} as t, length({text}) as n from {name}),
z as (select *, abs((n - avg(n) over ()) / stddev_samp(n) over ()) as z from n)
select row_index, round(least(z / 4, 1.0), 4) as score, case when least(z / 4, 1.0) >= 0.85 then 'critical' when least(z / 4, 1.0) >= 0.65 then 'high' when least(z / 4, 1.0) >= 0.4 then 'medium' else 'low' end as severity,
  round(z, 2) as length_z from z where z >= 1.5 order by round(least(z / 4, 1.0), 4) desc, row_index limit 5
"""


def _text_outliers(rows: DataFrame) -> DataFrame:
    found = anomalies.text_outliers(rows, "text", None)
    return found.select("row_index", "score", "severity", F.element_at("evidence", "length_z").cast("double").alias("length_z"))


@query(_TEXT_SQL.format(key="p_partkey", text="p_name", name="part"))
def text_length_outliers(spark, sf_dir):
    return _text_outliers(table(spark, sf_dir, "part").selectExpr("p_partkey as row_index", "p_name as text"))


@query(_TEXT_SQL.format(key="doc_id", text="text", name="documents"))
def text_length_outliers_documents(spark, sf_dir):
    return _text_outliers(table(spark, sf_dir, "documents").selectExpr("doc_id as row_index", "text"))


@query()
def isolation_forest_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return anomalies.numeric_anomalies(rows, entity="l_quantity").select("row_index", "metric", "score", "severity", "seq")


_CANDIDATES = """
select 'a' as source, p_partkey % 50 as row_index, p_brand as entity, p_type as metric, p_retailprice / 2200 as score, p_partkey as seq from part
union all select 'b', p_partkey % 50, p_brand, p_type, p_size / 50.0, p_partkey + 1000000 from part"""


@query(f"""
with k as (select *, row_number() over (partition by entity, metric, row_index order by score desc, seq) as n from ({_CANDIDATES}))
select source, row_index, entity, metric, round(score, 6) as score, seq from k where n = 1 order by k.score desc, k.seq limit 10
""")
def anomaly_merge_dedup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    row = (F.col("p_partkey") % 50).alias("row_index")
    a = part.select(F.lit("a").alias("source"), row, F.col("p_brand").alias("entity"), F.col("p_type").alias("metric"), (F.col("p_retailprice") / 2200).alias("score"), F.col("p_partkey").alias("seq"))
    b = part.select(F.lit("b").alias("source"), row, F.col("p_brand").alias("entity"), F.col("p_type").alias("metric"), (F.col("p_size") / 50.0).alias("score"), (F.col("p_partkey") + 1000000).alias("seq"))
    return anomalies.merge_candidates(a.unionByName(b)).withColumn("score", F.round("score", 6))


@query(r"""
with r as (select 'p_brand:' || regexp_replace(trim(p_brand), '[^\w.-]+', '_', 'g') as graph_entity_id, row_number() over (order by p_retailprice desc, p_partkey) - 1 as place from part order by p_retailprice desc, p_partkey limit 50)
select graph_entity_id, array_to_string(list(place order by place), ',') as positions from r group by graph_entity_id
""")
def entity_index(spark, sf_dir):
    top = table(spark, sf_dir, "part").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(50)
    records = top.select(scalars.graph_id("p_brand", F.col("p_brand")).alias("graph_entity_id"), F.col("p_retailprice").alias("score"), F.col("p_partkey").alias("seq"))
    return anomalies.entity_index(records).select("graph_entity_id", F.array_join("positions", ",").alias("positions"))


_ODD = """
c as (select case when p_size % 2 = 0 then 'text_heuristic' else 'isolation_forest' end as source, p_partkey as row_index, p_name as entity, 'Part_ID' as entity_column, p_type as metric, p_retailprice / 2200 as score, p_partkey as seq from part),
x as (select row_index, case when source = 'text_heuristic' then 'The ' || metric || ' of ' || entity || ' is far longer or shorter than the others.' else 'Taken together, the numbers of ' || entity || ' are unlike other rows, ' || metric || ' most of all.' end as hypothesis,
  case when source = 'text_heuristic' then 'Read the ' || metric || ' of ' || entity || '.' else 'Check ' || metric || ' of ' || entity || ' at its source, and what happened around it.' end as recommended_action,
  'part:' || substr(regexp_replace(trim(entity), '[^\\w.-]+', '_', 'g'), 1, 64) as graph_entity_id from c)"""


def _records(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rows = part.selectExpr(
        "case when p_size % 2 = 0 then 'text_heuristic' else 'isolation_forest' end as source", "p_partkey as row_index", "p_name as entity", "'Part_ID' as entity_column", "p_type as metric",
        "p_retailprice / 2200 as score", "p_partkey as seq",
    )
    return anomalies.explain(rows)


@query(f"with {_ODD} select * from x")
def anomaly_explanations(spark, sf_dir):
    return _records(spark, sf_dir).select("row_index", "hypothesis", "recommended_action", "graph_entity_id")


@query(f"with {_ODD} select row_index, graph_entity_id from x where graph_entity_id = (select min(graph_entity_id) from x)")
def anomalies_of_entity(spark, sf_dir):
    records = _records(spark, sf_dir)
    return anomalies.of_entity(records, records.agg(F.min("graph_entity_id")).first()[0]).select("row_index", "graph_entity_id")


@query("select p_partkey, case when p_partkey % 4 = 0 then 'Row ' || (row_number() over (order by p_partkey)) else p_name end as entity from part")
def entity_labels(spark, sf_dir):
    rows = anomalies.indexed(table(spark, sf_dir, "part").selectExpr("p_partkey", "case when p_partkey % 8 = 0 then null when p_partkey % 4 = 0 then '  ' else concat(' ', p_name) end as name"))
    return rows.select("p_partkey", anomalies.entity_label("name").alias("entity"))


@query("""
with h as (select o_orderkey, case when o_orderkey % 5 = 0 then null else o_totalprice end as price from orders), m as (select o_orderkey, coalesce(price, (select median(price) from h)) as price from h)
select o_orderkey, round((price - avg(price) over ()) / stddev_pop(price) over (), 4) as z from m
""")
def feature_impute(spark, sf_dir):
    rows, names = anomalies.scaled_features(_holes(spark, sf_dir).select("o_orderkey", "price"), ["price"])
    return rows.select("o_orderkey", F.round(names[0], 4).alias("z"))


_TWO_TEXTS = """
with r as (select row_number() over (order by p_partkey) - 1 as row_index, p_partkey, p_name as description, p_type as note from part),
z as (select row_index, p_partkey, 'description' as metric, abs((length(description) - avg(length(description)) over ()) / stddev_samp(length(description)) over ()) as z from r
  union all select row_index, p_partkey, 'note', abs((length(note) - avg(length(note)) over ()) / stddev_samp(length(note)) over ()) from r),
k as (select *, round(least(z / 4, 1.0), 4) as score, row_number() over (partition by metric order by round(least(z / 4, 1.0), 4) desc, row_index) as n from z where z >= 1.5)
select 'text_heuristic' as source, row_index, p_partkey::varchar as entity, metric, score from k where n <= 5
"""


@query(_TWO_TEXTS)
def text_anomalies_by_column(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey as part_id", "p_name as description", "p_type as note")
    return anomalies.text_anomalies(rows, "part_id").select("source", "row_index", "entity", "metric", "score")


# --- forecasts ----------------------------------------------------------------------------------


@query("select o_orderdate::date as ds, round(sum(o_totalprice), 2) as y from orders group by 1")
def daily_series_sum(spark, sf_dir):
    return forecast.daily_series(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice").withColumn("y", F.round("y", 2))


@query("select ts::date as ds, round(avg(value), 4) as y from events group by 1")
def daily_series_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumnRenamed("value", "stock_level")
    return forecast.daily_series(rows, "ts", "stock_level").withColumn("y", F.round("y", 4))


_DAILY = "with d as (select o_orderdate::date as ds, sum(o_totalprice) as y from orders group by 1), n as (select *, row_number() over (order by ds) - 1 as t from d), "
_FIT = "f as (select count(*)::bigint as n, regr_slope(y, t) as slope, regr_intercept(y, t) as intercept, sqrt((regr_syy(y, t) - regr_slope(y, t) * regr_sxy(y, t)) / count(*)) as sigma, max(ds) as last_day from n) "


@query(_DAILY + _FIT + "select n, round(slope, 4) as slope, round(intercept, 2) as intercept, round(sigma, 2) as sigma, last_day from f")
def linear_forecast_params(spark, sf_dir):
    p = forecast.linear_params(forecast.daily_series(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice"))
    return p.select("n", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("sigma", 2).alias("sigma"), "last_day")


@query(_DAILY + _FIT + """
select (last_day + cast(h as integer))::date as date, round(round(intercept + slope * (n + h - 1), 4), 2) as value, round(round(intercept + slope * (n + h - 1) - 1.96 * sigma, 4), 2) as lower, round(round(intercept + slope * (n + h - 1) + 1.96 * sigma, 4), 2) as upper
from f, (select unnest(range(1, 31)) as h)
""")
def linear_forecast_30d(spark, sf_dir):
    out = forecast.linear_forecast(forecast.daily_series(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice"))
    return out.select("date", *[F.round(c, 2).alias(c) for c in ("value", "lower", "upper")])


@query(_DAILY + _FIT + """,
s as (select dayofweek(ds) as dow, avg(y - intercept - slope * t) as effect from n, f group by 1),
x as (select stddev_pop(y - intercept - slope * t - effect) as sigma from n, f, s where dayofweek(ds) = dow),
h as (select (last_day + cast(unnest(range(1, 31)) as integer))::date as date, unnest(range(1, 31)) as h from f),
v as (select date, intercept + slope * (f.n + h - 1) + coalesce(effect, 0) as y, x.sigma from f, x, h left join s on dayofweek(date) = dow)
select date, round(round(y, 4), 2) as value, round(round(y - 1.2816 * sigma, 4), 2) as lower, round(round(y + 1.2816 * sigma, 4), 2) as upper from v
""")
def weekly_forecast_30d(spark, sf_dir):
    out, model = forecast.train(forecast.daily_series(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice"))
    assert model == "weekly"
    return out.select("date", *[F.round(c, 2).alias(c) for c in ("value", "lower", "upper")])


@query("""
select 'orders' as name, case when count(distinct o_orderdate::date) >= 5 then 'success' when count(*) > 0 then 'skipped' end as status from orders
union all select 'first days', 'skipped' from (select min(o_orderdate::date) as d from orders) where (select count(distinct o_orderdate::date) from orders where o_orderdate::date < d + 4) < 5
union all select 'customer', case when count(distinct c_mktsegment) between 2 and 15 then 'snapshot' else 'skipped' end from customer
union all select 'names', 'skipped' from (select count(*) from nation)
""")
def forecast_status(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice")
    first = orders.agg(F.to_date(F.min("o_orderdate"))).first()[0]
    tables = {
        "orders": orders, "first days": orders.filter(F.to_date("o_orderdate") < F.date_add(F.lit(first), 4)),
        "customer": table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal"), "names": table(spark, sf_dir, "nation").select("n_name"),
    }
    return spark.createDataFrame([(name, forecast.run(df).status) for name, df in tables.items()], "name string, status string")


@query('select c_mktsegment as "group", round(avg(c_acctbal), 2) as mean from customer group by 1')
def snapshot_means(spark, sf_dir):
    return forecast.group_means(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal")


# --- graphs -------------------------------------------------------------------------------------

_MEET = """
with e as (select o_orderkey, 'o_orderstatus:' || o_orderstatus as a, 'o_orderpriority:' || regexp_replace(trim(o_orderpriority), '[^\\w.-]+', '_', 'g') as b from orders)"""


def _orders_graph(spark, sf_dir):
    return kgraph.extract(table(spark, sf_dir, "orders").withColumn("_row_id", F.col("o_orderkey")), ["o_orderstatus", "o_orderpriority"])


@query(_MEET + "select distinct a as id, split_part(a, ':', 2) as label, 'o_orderstatus' as node_type from e union select distinct b, split_part(b, ':', 2), 'o_orderpriority' from e")
def graph_nodes(spark, sf_dir):
    return _orders_graph(spark, sf_dir)[0].select("id", "label", "node_type")


@query(_MEET + "select least(a, b) as source, greatest(a, b) as target, 'o_orderpriority_o_orderstatus' as relation, count(*)::double as weight from e group by 1, 2")
def graph_edges(spark, sf_dir):
    return _orders_graph(spark, sf_dir)[1]


_NETWORK = "with p as (select distinct 'b:' || p_brand as a, 't:' || p_name as b from part), "


def _network(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").select(F.concat(F.lit("b:"), "p_brand").alias("source"), F.concat(F.lit("t:"), "p_name").alias("target")).distinct()
    edges = pairs.select("source", "target", F.lit("b_t").alias("relation"), F.lit(1.0).alias("weight"))
    ids = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    nodes = ids.select(
        "id", scalars.label_of(F.col("id")).alias("label"), scalars.type_of(F.col("id")).alias("node_type"), F.row_number().over(Window.orderBy("id")).cast("long").alias("first_seen"),
        F.lit(False).alias("is_anomaly"), F.lit(0.0).alias("centrality"), F.create_map().cast("map<string,string>").alias("metadata"),
    )
    return nodes, edges


_DEGREE = _NETWORK + "n as (select a as id from p union all select b from p), c as (select id, count(*) / ((select count(distinct id) from n) - 1)::double as centrality from n group by id) "


@query(_DEGREE + "select id, round(centrality, 4) as centrality from c")
def degree_centrality(spark, sf_dir):
    return kgraph.centrality(*_network(spark, sf_dir)).select("id", "centrality")


@query(_DEGREE + "select id, round(centrality, 4) as centrality from c order by round(centrality, 4) desc, id limit 5")
def graph_hubs(spark, sf_dir):
    return kgraph.hubs(kgraph.centrality(*_network(spark, sf_dir))).select("id", "centrality")


@query(_NETWORK + """
s as (select min(a) as id from p), e as (select a, b from p union all select b, a from p),
h1 as (select distinct e.b as id from e join s on e.a = s.id), h2 as (select distinct e.b as id from e join h1 on e.a = h1.id)
select id, 0 as hop from s union all select id, 1 from h1 union all select id, 2 from h2 where id not in (select id from h1) and id not in (select id from s)
""")
def k_hop_neighbourhood(spark, sf_dir):
    _, edges = _network(spark, sf_dir)
    start = edges.agg(F.min("source")).first()[0]
    return kgraph.neighbourhood(edges, start)


_BAD = "f as (select distinct 'b:' || p_brand as id from part where p_retailprice >= (select max(p_retailprice) * 0.99 from part)), "


def _flagged(spark, sf_dir):
    nodes, edges = _network(spark, sf_dir)
    part = table(spark, sf_dir, "part")
    top = part.crossJoin(F.broadcast(part.agg(F.max("p_retailprice").alias("_top")))).filter(F.col("p_retailprice") >= F.col("_top") * 0.99)
    return kgraph.centrality(kgraph.flag(nodes, top.select(F.concat(F.lit("b:"), "p_brand").alias("graph_entity_id"))), edges), edges


@query(_NETWORK + _BAD + "n as (select a as id from p union select b from p) select n.id, f.id is not null as is_anomaly from n left join f on n.id = f.id")
def anomaly_flags(spark, sf_dir):
    return _flagged(spark, sf_dir)[0].select("id", "is_anomaly")


_KEPT = _NETWORK + _BAD + """
n as (select a as id from p union all select b from p), c as (select id, round(count(*) / ((select count(distinct id) from n) - 1)::double, 4) as centrality from n group by id),
k as (select c.id, c.centrality, f.id is not null as bad from c left join f on c.id = f.id),
r as (select *, row_number() over (partition by bad order by centrality desc, id) as n from k),
kept as (select id, bad from r where bad or n <= greatest(0, 40 - (select count(*) from k where bad)))
"""


@query(_KEPT + "select id, bad as is_anomaly from kept")
def graph_prune(spark, sf_dir):
    return kgraph.prune(*_flagged(spark, sf_dir), most=40)[0].select("id", "is_anomaly")


@query(_KEPT + "select a as source, b as target from p where a in (select id from kept) and b in (select id from kept)")
def graph_prune_edges(spark, sf_dir):
    return kgraph.prune(*_flagged(spark, sf_dir), most=40)[1].select("source", "target")


@query(_MEET + """, n as (select distinct a as id from e union select distinct b from e),
r as (select 'o_orderstatus:' || o_orderstatus as id, case when o_orderstatus = 'F' then 'Finished' else '' end as label, true as bad from orders group by 1, 2 union all select 'new:x', 'x', false)
select coalesce(n.id, r.id) as id, coalesce(nullif(r.label, ''), split_part(n.id, ':', 2)) as label, coalesce(r.bad, false) as is_anomaly, case when r.id is null then '' else 'yes' end as merged from n full join r on n.id = r.id
""")
def graph_merge_nodes(spark, sf_dir):
    nodes, _ = _orders_graph(spark, sf_dir)
    changed = nodes.filter("node_type = 'o_orderstatus'").withColumn("label", F.when(F.col("label") == "F", "Finished").otherwise("")).withColumn("is_anomaly", F.lit(True))
    right = changed.unionByName(spark.createDataFrame([("new:x", "x", "new", 0, False, 0.0, {})], kgraph.NODE)).withColumn("metadata", F.create_map(F.lit("merged"), F.lit("yes")))
    return kgraph.merge_nodes(nodes, right).select("id", "label", "is_anomaly", F.coalesce(F.try_element_at("metadata", F.lit("merged")), F.lit("")).alias("merged"))


@query("""
with e as (select case when o_orderkey % 3 = 0 then null else 'o_orderstatus:' || o_orderstatus end as a, case when o_orderkey % 4 = 0 then null else 'o_orderpriority:' || regexp_replace(trim(o_orderpriority), '[^\\w.-]+', '_', 'g') end as b from orders)
select id, count(*)::bigint as neighbours, sum(n)::double as weight from (select a as id, b as other, count(*) as n from e where a is not null and b is not null group by 1, 2 union all select b, a, count(*) from e where a is not null and b is not null group by 1, 2) group by id
""")
def graph_without_blanks(spark, sf_dir):
    """Blank and null values make no nodes."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey as _row_id", "case when o_orderkey % 3 = 0 then '  ' else o_orderstatus end as o_orderstatus", "case when o_orderkey % 4 = 0 then null else o_orderpriority end as o_orderpriority")
    nodes, edges = kgraph.extract(rows, ["o_orderstatus", "o_orderpriority"])
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"), "weight").groupBy("id").agg(F.count("*").alias("neighbours"), F.sum("weight").alias("weight"))
    return nodes.select("id").join(ends, "id")


@query(_MEET + """, p as (select distinct a, b from e), n as (select a as id from p union all select b from p),
w as (select a as source, b as target, count(*) as weight from e group by 1, 2)
select n.id, round(count(*) / ((select count(distinct id) from n) - 1)::double, 4) as centrality, n.id = 'o_orderstatus:F' as is_anomaly, (select sum(weight) from w)::double as all_weight from n group by n.id
""")
def graph_build(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    nodes, edges = kgraph.build(rows, spark.createDataFrame([("o_orderstatus:F",), (None,)], "graph_entity_id string"), rows=None)
    return nodes.crossJoin(F.broadcast(edges.agg(F.sum("weight").alias("all_weight")))).select("id", "centrality", "is_anomaly", "all_weight")


@query(_MEET + "select least(a, b) as source, greatest(a, b) as target, 'o_orderpriority_o_orderstatus' as relation, 2.0 * count(*)::double as weight from e group by 1, 2")
def graph_merge(spark, sf_dir):
    _, edges = _orders_graph(spark, sf_dir)
    return kgraph.merge_edges(edges, edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "relation", "weight"))


@query("select p_partkey as part_key, p_name as part_name, p_size as size_of_part from part")
def key_names(spark, sf_dir):
    messy = table(spark, sf_dir, "part").select(F.col("p_partkey").alias(" Part-Key"), F.col("p_name").alias("PART - name"), F.col("p_size").alias("Size of-Part "))
    return cleaning.rename(messy, {c: key(c) for c in messy.columns})


@query("select date_trunc('week', o_orderdate)::date as week, round(sum(o_totalprice), 2) as value, count(*)::bigint as rows from orders where o_orderkey % 6 <> 0 group by 1")
def weekly_of_text_dates(spark, sf_dir):
    """Dates as text of two formats; one row in six can't be read."""
    text = "case when o_orderkey % 6 = 0 then 'soon' when o_orderkey % 2 = 0 then date_format(o_orderdate, 'yyyy-MM-dd') else date_format(o_orderdate, 'dd/MM/yyyy') end as day"
    rows = table(spark, sf_dir, "orders").selectExpr(text, "o_totalprice").filter("day is not null")
    return patterns.weekly(rows, "day", "o_totalprice").withColumn("value", F.round("value", 2))


@query("""
select o.o_orderkey as order_key, o.o_custkey as cust_key, 'orders.csv' as _source_file, c.c_name as name, case when c.c_custkey is null then null else 'customer.csv' end as "_source_file_customer.csv"
from orders o left join customer c on o.o_custkey = c.c_custkey
""")
def combine_by_shared_keys(spark, sf_dir):
    """The primary table is not the first, and one of the plan's keys is in one table only."""
    customer = table(spark, sf_dir, "customer").selectExpr("c_custkey as cust_key", "c_name as name")
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey as order_key", "o_custkey as cust_key")
    return cleaning.combine({"customer.csv": customer, "orders.csv": orders}, CleaningPlan(join_keys=("cust_key", "order_key"), primary="orders.csv"))


_NAMED = {"(select c_custkey as cust_key, c_nationkey as nation_key, c_acctbal as balance from customer)": ["cust_key", "nation_key", "balance"], "(select o_orderkey as order_key, o_custkey as cust_key, o_totalprice as balance from orders)": ["order_key", "cust_key", "balance"]}


@query(" intersect ".join(f"select column_name as join_key from ({_KEYS_SQL.format(profile=_profile_sql(t + ' t', c))})" for t, c in _NAMED.items()))
def plan_join_keys(spark, sf_dir):
    """Candidate keys that all files have."""
    tables = {
        "customer.csv": table(spark, sf_dir, "customer").selectExpr("c_custkey as cust_key", "c_nationkey as nation_key", "c_acctbal as balance"),
        "orders.csv": table(spark, sf_dir, "orders").selectExpr("o_orderkey as order_key", "o_custkey as cust_key", "o_totalprice as balance"),
    }
    plan = heuristic_plan(pipeline.build_profile(tables, list(tables)))
    return spark.createDataFrame([(k,) for k in plan.join_keys], "join_key string")


# --- sources, plans and streams -----------------------------------------------------------------


def _file(spark: SparkSession, name: str, text: str | bytes) -> str:
    """A small text file in the shared folder."""
    path = f"{shared_path(spark, 'sources')}/{name}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode() if isinstance(text, str) else text))
    out.close()
    return path


def _nations(spark, sf_dir) -> list[dict]:
    return [r.asDict() for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # 25 rows


_NATION = "select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey{more} from nation"


@query(_NATION.format(more=", '2024-01-01' as day, n_nationkey + 0.5::double as rate"))
def csv_scan(spark, sf_dir):
    lines = ["n_nationkey;n_name;n_regionkey;day;rate", *(f"{r['n_nationkey']};\"{r['n_name']}\";{r['n_regionkey']};2024-01-01;{r['n_nationkey'] + 0.5}" for r in _nations(spark, sf_dir))]
    return readers.load_file(spark, _file(spark, "nation.csv", "\n".join(lines) + "\n")).drop("_row_id")


@query(_NATION.format(more=""))
def json_array_scan(spark, sf_dir):
    return readers.load_file(spark, _file(spark, "nation.json", json.dumps(_nations(spark, sf_dir)))).drop("_row_id")


@query(_NATION.format(more=""))
def json_envelope_scan(spark, sf_dir):
    return readers.load_file(spark, _file(spark, "nation.json", json.dumps({"records": _nations(spark, sf_dir), "page": 1}, indent=1))).drop("_row_id")


@query(_NATION.format(more=""))
def ndjson_scan(spark, sf_dir):
    return readers.load_file(spark, _file(spark, "nation.ndjson", "\n".join(map(json.dumps, _nations(spark, sf_dir))))).drop("_row_id")


@query("select n_nationkey::bigint as n_nationkey, n_name || ' é' as n_name, e as encoding from nation, (values ('latin-1'), ('utf-8'), ('utf-8-sig')) v(e)")
def encodings_scan(spark, sf_dir):
    text = "\n".join(["n_nationkey,n_name", *(f"{r['n_nationkey']},{r['n_name']} é" for r in _nations(spark, sf_dir))]) + "\n"
    out = None
    for encoding in ("latin-1", "utf-8", "utf-8-sig"):
        rows = readers.load_file(spark, _file(spark, "nation.csv", text.encode(encoding))).drop("_row_id").withColumn("encoding", F.lit(encoding))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("select n_name, r_name from nation join region on n_regionkey = r_regionkey")
def load_files_as_views(spark, sf_dir):
    """Two files found by a pattern, loaded by name and joined as views."""
    folder = shared_path(spark, "files")
    for name, text in (
        ("nation_file.csv", "\n".join(["n_name;n_regionkey", *(f"{r['n_name']};{r['n_regionkey']}" for r in _nations(spark, sf_dir))])),
        ("region_file.json", json.dumps([r.asDict() for r in table(spark, sf_dir, "region").collect()])),  # 5 rows
    ):
        sinks.write_text(f"{folder}/{name}", text)
    paths = readers.expand(spark, [f"{folder}/*_file.*", f"{folder}/region*"])
    assert [p.rsplit("/", 1)[-1] for p in paths] == ["nation_file.csv", "region_file.json"]
    loaded = readers.load_files(spark, paths)
    assert set(loaded) == {"nation_file.csv", "region_file.json"}
    return spark.sql("select n_name, r_name from nation_file join region_file on n_regionkey = r_regionkey")


@query("""
with o as (select count(*) as n, count(distinct o_orderdate::date) as days, sum(o_totalprice) as total, avg(o_totalprice) as mean, count(distinct o_orderstatus) + count(distinct o_orderpriority) as nodes from orders)
select 'profile' as artifact, 'rows' as measure, n::double as value from o union all select 'cleaning', 'rows_after', n from o union all select 'cleaned', 'total', round(total, 2) from o
union all select 'patterns', 'rows', n from o union all select 'patterns', 'mean_price', round(mean, 4) from o union all select 'anomalies', 'rows', n from o
union all select 'anomalies', 'listed', 10 from o union all select 'forecast', 'days', days from o union all select 'graph', 'nodes', nodes from o union all select 'raw', 'files', 1 from o
""")
def pipeline_artifacts(spark, sf_dir):
    """All phases on the orders; what the files of the run say."""
    folder = pipeline.run(spark, [f"{sf_dir}/orders.parquet"], shared_path(spark, "runs"), "orders").folder
    read = {name: sinks.read_artifact(folder, name) for name in sinks.ARTIFACTS}
    total = spark.read.parquet(f"{folder}/cleaned.parquet").agg(F.round(F.sum("o_totalprice"), 2)).first()[0]
    price = next(r["avg"] for r in read["patterns"]["statistics"]["numeric_summary"] if r["column"] == "o_totalprice")
    rows = [
        ("profile", "rows", read["profile"]["files"]["orders.parquet"]["row_count"]), ("cleaning", "rows_after", read["cleaning_report"]["rows_after"]), ("cleaned", "total", total),
        ("patterns", "rows", read["patterns"]["row_count"]), ("patterns", "mean_price", price), ("anomalies", "rows", read["anomalies"]["row_count"]),
        ("anomalies", "listed", len(read["anomalies"]["anomalies"])), ("forecast", "days", len(read["forecast"]["history"])), ("graph", "nodes", read["graph"]["node_count"]),
        ("raw", "files", len(readers.expand(spark, [f"{folder}/raw/*"]))),
    ]
    return spark.createDataFrame([(a, m, float(v)) for a, m, v in rows], "artifact string, measure string, value double")


@query("select n_name, row_number() over (order by n_nationkey) - 1 as place from nation")
def parquet_scan(spark, sf_dir):
    rows = readers.load_file(spark, f"{sf_dir}/nation.parquet")
    return anomalies.indexed(rows).select("n_name", F.col("row_index").alias("place"))


@query("""
with d as (select o_orderkey as order_id, case when o_orderkey % 9 = 0 then null else floor(o_totalprice) end as p, o_orderdate::date as order_date from orders)
select order_id, coalesce(p, (select median(p) from d))::double as total_price, order_date from d
""")
def heuristic_cleaning(spark, sf_dir):
    """Profile, plan, clean and validate, with no plan given."""
    dirty = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("Order ID"),
        F.expr("case when o_orderkey % 9 = 0 then null else concat('$', cast(cast(floor(o_totalprice) as bigint) as string)) end").alias("Total  Price"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("Order Date"),
    )
    tables = {"orders.csv": cleaning.with_row_id(dirty)}
    plan = heuristic_plan(pipeline.build_profile(tables, ["orders.csv"]))
    cleaned, _ = cleaning.execute_plan(tables, plan)
    assert cleaning.validate(cleaned, plan).passed
    return cleaned.drop("_row_id")


@query("select date_trunc('week', ts)::date as week, round(sum(value), 4) as value, count(*)::bigint as rows from events group by 1")
def stream_weekly(spark, sf_dir):
    """The events as a stream of files; the memory sink holds a row a week."""
    path = f"{sf_dir}/event[s].parquet"  # a pattern, as a stream of a single file needs
    name = f"weeks_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(path)
    run = trends.weekly(stream, "ts", "value").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", shared_path(spark, "stream")).start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    return spark.table(name).withColumn("value", F.round("value", 4))
