"""Relational queries over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.plans.registry import query
from docweave.sources.corpus import table


@query("ge01_pricing_summary", "select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, sum(l_extendedprice * (1 - l_discount)) as revenue, avg(l_discount) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def ge01(spark, sf):
    l = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("n"))


@query("ge02_revenue_by_nation", "select n_name, sum(l_extendedprice * (1 - l_discount)) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name")
def ge02(spark, sf):
    t = lambda name: table(spark, sf, name)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@query("ge03_cube", "select c_mktsegment, o_orderpriority, count(*) as n from orders join customer on o_custkey = c_custkey group by cube (c_mktsegment, o_orderpriority)")
def ge03(spark, sf):
    j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.cube("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"))


@query("ge04_customers_without_urgent_orders", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def ge04(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
