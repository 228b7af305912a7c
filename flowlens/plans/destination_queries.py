"""Destinations by party, roll-ups by category, and joins of summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import summaries

from .inputs import read
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()

SUPPORT = ["supplier#00000000", "#000000001"]
#: A destination is a part of an order line, its organisation the supplier, its device the customer's segment.
_DEST = """with d as (select c_mktsegment as device, n_name as category, s_name as org, o_orderkey, l_linenumber, s_nationkey = c_nationkey as own
  from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey join nation on n_nationkey = c_nationkey % 5),
y as (select *, case when own then 1 when contains(lower(org), 'supplier#00000000') or contains(lower(org), '#000000001') then 2 else 3 end as party from d),
c as (select device, category, count_if(party = 1)::bigint as first, count_if(party = 2)::bigint as support, count_if(party = 3)::bigint as third, count(*) as total from y group by all)
"""


def _destinations(spark, sf_dir):
    t = {n: read(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier", "nation")}
    rows = t["lineitem"].join(t["orders"], F.col("o_orderkey") == F.col("l_orderkey")).join(t["customer"], F.col("c_custkey") == F.col("o_custkey")).join(t["supplier"], F.col("s_suppkey") == F.col("l_suppkey"))
    rows = rows.join(t["nation"], F.col("n_nationkey") == F.col("c_nationkey") % 5)
    own = F.when(F.col("s_nationkey") == F.col("c_nationkey"), F.array("s_name")).otherwise(F.array().cast("array<string>"))
    return rows.select(F.col("c_mktsegment").alias("device"), F.col("n_name").alias("category"), F.col("s_name").alias("org"), "o_orderkey", "l_linenumber", summaries.party(F.col("s_name"), own, SUPPORT).alias("party"))


def _counts(spark, sf_dir):
    return summaries.party_counts(_destinations(spark, sf_dir), ["device", "category"])


@query(_DEST + "select o_orderkey, l_linenumber, org, party from y")
def party_classification(spark, sf_dir):
    return _destinations(spark, sf_dir).select("o_orderkey", "l_linenumber", "org", "party")


@query(_DEST + "select * from c")
def party_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(_DEST + "select device, coalesce(sum(total) filter (where category = 'NATION_0'), 0)::bigint as \"NATION_0\", coalesce(sum(total) filter (where category = 'NATION_1'), 0)::bigint as \"NATION_1\" from c group by device")
def party_pivot(spark, sf_dir):
    return _destinations(spark, sf_dir).groupBy("device").pivot("category", ["NATION_0", "NATION_1"]).count().na.fill(0)


@query(_DEST + "select coalesce(category, 'Total') as category, sum(first)::bigint as first, sum(support)::bigint as support, sum(third)::bigint as third, sum(total)::bigint as total from c group by rollup (category)")
def category_rollup(spark, sf_dir):
    return summaries.category_totals(_counts(spark, sf_dir), "category")


@query(_DEST + "select device, category, first, support, third, total, round(first * 100.0 / total, 6) as first_percent, round(support * 100.0 / total, 6) as support_percent, round(third * 100.0 / total, 6) as third_percent from c")
def percent_of_total(spark, sf_dir):
    out = summaries.shares(_counts(spark, sf_dir), ["first", "support", "third"])
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("percent") else F.col(c) for c in out.columns])


@query("""with a as (select c_nationkey as k, count(*) as n, sum(c_custkey)::bigint as s from customer where c_custkey % 3 = 0 group by 1), b as (select s_nationkey as k, count(*) as n, sum(s_suppkey)::bigint as s from supplier group by 1)
select coalesce(a.k, b.k) as k, coalesce(a.n, 0) + coalesce(b.n, 0) as n, coalesce(a.s, 0) + coalesce(b.s, 0) as s from a full join b on a.k = b.k""")
def outer_sum(spark, sf_dir):
    a = read(spark, sf_dir, "customer").where("c_custkey % 3 = 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("s"))
    b = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("s"))
    return summaries.outer_sum(a, b, ["k"], ["n", "s"])


@query("select p_type as value, count(*) as n, row_number() over (order by count(*) desc, p_type) as place from part group by p_type")
def value_counts(spark, sf_dir):
    counts = read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("value")).agg(F.count("*").alias("n")).withColumn("_one", F.lit(1))
    return summaries.ranked(counts, [F.desc("n"), F.asc("value")], "_one", "place").drop("_one")


@query("select p_brand, p_type, p_size, count(*) as n from part group by all")
def group_sizes(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_brand", "p_type", "p_size").agg(F.count("*").alias("n"))


@query("select p_type, count(*) as before_filter, count(*) filter (where p_size > 20) as after_filter from part group by p_type")
def filter_histogram(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("before_filter"), F.count_if(F.col("p_size") > 20).alias("after_filter"))


@query("with m as (select s_nationkey as category, s_suppkey, count(*) as models from supplier join lineitem on l_suppkey = s_suppkey group by all) select category, count(*) as devices, sum(models)::bigint as total, round(avg(models), 6) as mean, median(models) as middle, round(stddev_pop(models), 6) as spread from m group by category")
def model_statistics(spark, sf_dir):
    models = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("models")).join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return models.groupBy(F.col("s_nationkey").alias("category")).agg(F.count("*").alias("devices"), F.sum("models").alias("total"), F.round(F.avg("models"), 6).alias("mean"), F.median("models").alias("middle"), F.round(F.stddev_pop("models"), 6).alias("spread"))


@query("select concat('x', cast(c_nationkey % 9 as varchar), '.example.com') as domain, string_agg(distinct c_mktsegment, ',' order by c_mktsegment) as devices, count(distinct c_mktsegment) as n_devices from customer group by 1")
def inverted_index(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").selectExpr("concat('x', c_nationkey % 9, '.example.com') as domain", "c_mktsegment")
    return rows.groupBy("domain").agg(F.array_join(F.sort_array(F.collect_set("c_mktsegment")), ",").alias("devices"), F.count_distinct("c_mktsegment").alias("n_devices"))


@query("select n_name, r_name, count(*) as n_customers, round(sum(c_acctbal), 2) as balance from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where r_name <> 'none' group by all")
def category_lookup(spark, sf_dir):
    dims = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).where("r_name <> 'none'")
    rows = read(spark, sf_dir, "customer").join(dims, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name", "r_name").agg(F.count("*").alias("n_customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("select count(*) as all_total, count_if(p_size <= 10)::bigint as periodic, count_if(p_size > 10)::bigint as nonperiodic from part")
def summary_totals(spark, sf_dir):
    return read(spark, sf_dir, "part").agg(F.count("*").alias("all_total"), F.count_if(F.col("p_size") <= 10).alias("periodic"), F.count_if(F.col("p_size") > 10).alias("nonperiodic"))


@query(_DEST + "select device, to_json({'first': sum(first)::bigint, 'support': sum(support)::bigint, 'third': sum(third)::bigint})::varchar as summary from c group by device")
def json_summary(spark, sf_dir):
    sums = _counts(spark, sf_dir).groupBy("device").agg(*[F.sum(c).alias(c) for c in ("first", "support", "third")])
    return sums.select("device", F.to_json(F.struct("first", "support", "third")).alias("summary"))
