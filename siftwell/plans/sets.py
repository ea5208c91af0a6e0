"""Set operations and connected components."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.operators.graph import connected_components
from siftwell.operators.ranking import first_per_key
from siftwell.plans.registry import query
from siftwell.session import table


@query("u01_missing", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'")
def u01(spark, folder):
    seen = table(spark, folder, "orders").where("o_orderdate < timestamp_ntz'1999-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, folder, "customer").select("c_custkey").join(seen, "c_custkey", "left_anti")


@query("u02_hits", "SELECT l_orderkey, len(list_intersect(list(DISTINCT l_partkey), list(DISTINCT l_suppkey))) AS hits FROM lineitem GROUP BY l_orderkey")
def u02(spark, folder):
    rows = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("a"), F.collect_set("l_suppkey").alias("b"))
    return rows.select("l_orderkey", F.size(F.array_intersect("a", "b")).cast("long").alias("hits"))


@query("u03_universe", "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def u03(spark, folder):
    a, b = table(spark, folder, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")), table(spark, folder, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return a.union(b).distinct()


@query("u04_overlap", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag IN ('A', 'N') AND l_linestatus = 'O')")
def u04(spark, folder):
    rows = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("kinds"))
    return rows.where(F.arrays_overlap("kinds", F.array(F.lit("AO"), F.lit("NO")))).select("l_orderkey")


@query("u05_unknown", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT conv_id FROM conversations)")
def u05(spark, folder):
    known = table(spark, folder, "conversations").select(F.col("conv_id").alias("user_id"))
    return table(spark, folder, "events").select("user_id").distinct().join(known, "user_id", "left_anti")


# Parts and the two identities that each has, of size and brand and of name and price; components by their smallest part.
COMPONENTS = """WITH RECURSIVE e AS (SELECT p_partkey AS a, 's' || p_size || p_brand AS b FROM part UNION ALL SELECT p_partkey, 'n' || p_name || CAST(floor(p_retailprice / 7) AS BIGINT) % 40 FROM part),
  v AS (SELECT b, min(a) AS hub FROM e GROUP BY b), x AS (SELECT DISTINCT a AS u, hub AS w FROM e JOIN v USING (b) WHERE a <> hub), y AS (SELECT u, w FROM x UNION SELECT w, u FROM x),
  c(node, component) USING KEY (node) AS (SELECT p_partkey, p_partkey FROM part UNION (SELECT y.w, min(c.component) FROM c JOIN y ON c.node = y.u JOIN recurring.c AS now ON now.node = y.w WHERE c.component < now.component GROUP BY y.w))"""
FIRST_IDENTITY = 1 << 60


def identities(spark, folder):
    """(p_partkey, p_type, identity): identities are numbers above all parts, so a part names each component."""
    rows = table(spark, folder, "part")
    kinds = F.array(F.xxhash64(F.lit("s"), "p_size", "p_brand"), F.xxhash64(F.lit("n"), "p_name", F.floor(F.col("p_retailprice") / 7) % 40))
    return rows.select("p_partkey", "p_type", F.explode(F.transform(kinds, lambda h: F.shiftrightunsigned(h, 4) + FIRST_IDENTITY)).alias("identity"))


@query("u06_components", f"{COMPONENTS} SELECT node, component FROM c")
def u06(spark, folder):
    """Records that share an identity, directly or by others; edges go through the identities, so no pairs are formed."""
    return connected_components(identities(spark, folder), "p_partkey", "identity").where(F.col("node") < FIRST_IDENTITY)


@query("u07_conflicts", f"{COMPONENTS} SELECT component, count(DISTINCT p_type) AS companies, count(DISTINCT p_type) >= 2 AS deferred FROM c JOIN part ON p_partkey = node GROUP BY component")
def u07(spark, folder):
    """Components whose records name two companies or more are deferred."""
    groups = u06(spark, folder).withColumnRenamed("node", "p_partkey")
    rows = table(spark, folder, "part").join(groups, "p_partkey")
    return rows.groupBy("component").agg(F.count_distinct("p_type").alias("companies")).withColumn("deferred", F.col("companies") >= 2)


@query("u08_concatenate", "SELECT l_orderkey, arg_max(l_quantity, l_linenumber * 1000 + l_partkey / 1e6) AS quantity FROM (SELECT * FROM lineitem WHERE l_linenumber <= 3 UNION ALL SELECT * FROM lineitem WHERE l_linenumber > 2) GROUP BY l_orderkey")
def u08(spark, folder):
    """Partial work sets together, the newest of each key; of equals the one that is stored first. Rows without a value or an order don't count, their keys stay."""
    # the order as SQL computes it: part keys of 10^9 and more outweigh line numbers, and very large ones are equal in doubles
    newest = F.when(F.col("l_quantity").isNotNull(), F.col("l_linenumber") * 1000 + F.col("l_partkey") / F.lit(1e6))
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", newest.alias("newest"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    both = rows.where("l_linenumber <= 3").unionByName(rows.where("l_linenumber > 2"))
    first = first_per_key(both, ["l_orderkey"], [F.desc_nulls_last("newest"), F.col("file"), F.col("at")])
    return first.select("l_orderkey", F.when(F.col("newest").isNotNull(), F.col("l_quantity")).alias("quantity"))
