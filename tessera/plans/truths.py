"""Queries on truth lists: the lines of each order as a comma-joined list of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..session import table
from ..sources import tables

PAIRS = "p AS (SELECT l_orderkey AS entity, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS record FROM lineitem)"


def pairs(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("record"))


def orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("entity"))


@query("joined_links", f"WITH {PAIRS}, g AS (SELECT entity, string_agg(DISTINCT record, ',' ORDER BY record) AS ids FROM p GROUP BY entity) SELECT o_orderkey AS entity, coalesce(ids, '') AS ids FROM orders LEFT JOIN g ON entity = o_orderkey")
def joined_links(spark, d):
    return tables.joined_ids(orders(spark, d), pairs(spark, d))


@query("exploded_truth", f"WITH {PAIRS} SELECT DISTINCT entity, record FROM p JOIN orders ON entity = o_orderkey")
def exploded_truth(spark, d):
    t = tables.joined_ids(orders(spark, d), pairs(spark, d))
    return tables.explode_truth(t, "entity", "ids")


@query("truth_profile", f"WITH {PAIRS}, n AS (SELECT o_orderkey, count(record) AS n FROM orders LEFT JOIN (SELECT DISTINCT * FROM p) ON entity = o_orderkey GROUP BY 1) SELECT n AS matches, count(*) AS entities, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM n GROUP BY n")
def truth_profile(spark, d):
    n = orders(spark, d).join(pairs(spark, d).distinct().groupBy("entity").agg(F.count("*").alias("n")), "entity", "left").na.fill(0)
    total = n.agg(F.count("*").alias("t"))
    return n.groupBy(F.col("n").alias("matches")).agg(F.count("*").alias("entities")).crossJoin(F.broadcast(total)).select("matches", "entities", F.round(F.col("entities") / F.col("t"), 6).alias("share"))


@query("validated_links", f"""WITH {PAIRS}, dp AS (SELECT DISTINCT entity, record FROM p) SELECT 'unknown entity' AS problem, (SELECT count(DISTINCT entity) FROM dp WHERE entity NOT IN (SELECT o_orderkey FROM orders)) AS n UNION ALL SELECT 'missing entity', (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT entity FROM dp))
UNION ALL SELECT 'entity twice', 0 UNION ALL SELECT 'unknown record', 0 UNION ALL SELECT 'record of several entities', (SELECT count(*) FROM (SELECT record FROM dp GROUP BY record HAVING count(*) > 1))""")
def validated_links(spark, d):
    p = pairs(spark, d)
    links = p.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("record")), ",").alias("ids"))
    return tables.validate_links(links, orders(spark, d), p.select("record").distinct())


@query("owner_vector", """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS record, CASE WHEN l_returnflag <> 'N' THEN l_orderkey END::DOUBLE AS owner FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem)""")
def owner_vector(spark, d):
    """Every record with its owner; those returned as N are distractors and have none."""
    p = pairs(spark, d).withColumn("flag", F.lit(0))
    li = table(spark, d, "lineitem")
    matched = li.filter("l_returnflag != 'N'").select(F.col("l_orderkey").alias("entity"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("record")).distinct()
    return tables.owners(p.select("record").distinct(), matched).select("record", F.col("owner").cast("double").alias("owner"))


@query("true_pairs", "SELECT o_orderkey AS entity, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS record, o_orderpriority AS name1, p_name AS name2 FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey")
def true_pairs(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("record"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("entity"), F.col("o_orderpriority").alias("name1"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name2"))
    return o.join(li, o["entity"] == li["l_orderkey"]).join(p, "l_partkey").select("entity", "record", "name1", "name2")


@query("source_union", "SELECT 'customer' AS src, count(*) AS n, count(DISTINCT c_nationkey) AS nations FROM customer UNION ALL SELECT 'supplier', count(*), count(DISTINCT s_nationkey) FROM supplier")
def source_union(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    return tables.union_sources(customer=c, supplier=s).groupBy("src").agg(F.count("*").alias("n"), F.countDistinct("nation").alias("nations"))
