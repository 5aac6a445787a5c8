"""Report queries over the relational tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import history
from sparkloom.plans.base import query, read
from sparkloom.sources import buckets as B
from sparkloom.sources.stored import stored


@query("""SELECT l_suppkey AS reviewer, count(*) AS n, cast(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS approved,
cast(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS changes, cast(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS comments
FROM lineitem GROUP BY 1 ORDER BY n DESC, reviewer LIMIT 50""")
def reviewer_summary(spark, sf):
    one = lambda v, n: F.count_if(F.col("l_returnflag") == v).alias(n)
    out = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("reviewer")).agg(F.count("*").alias("n"), one("A", "approved"), one("R", "changes"), one("N", "comments"))
    return out.orderBy(F.desc("n"), "reviewer").limit(50)


@query("SELECT l_partkey AS path, count(*) AS n, count(DISTINCT l_orderkey) AS n_prs FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY 1")
def path_hotspots(spark, sf):
    return read(spark, sf, "lineitem").filter("l_partkey is not null").groupBy(F.col("l_partkey").alias("path")).agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("n_prs"))


@query("""SELECT count(*) AS n, cast(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS approved FROM lineitem WHERE l_orderkey = -1
UNION ALL SELECT count(*), cast(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) FROM lineitem""")
def global_review_summary(spark, sf):
    """Without rows the count is 0 and the sum is null."""
    one = lambda df: df.agg(F.count("*").alias("n"), F.sum((F.col("l_returnflag") == "A").cast("int")).alias("approved"))
    rows = read(spark, sf, "lineitem")
    return one(rows.filter("l_orderkey = -1")).unionByName(one(rows))


@query("""WITH hits AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey, o_orderstatus, n FROM hits JOIN orders ON l_orderkey = o_orderkey ORDER BY n DESC, o_orderkey LIMIT 100""")
def related_items_by_hits(spark, sf):
    hits = read(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    out = hits.join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return out.select("o_orderkey", "o_orderstatus", "n").orderBy(F.desc("n"), "o_orderkey").limit(100)


@query("""SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey = 7 GROUP BY 1, 2, 3, 4""")
def reviewer_related_prs(spark, sf):
    rows = read(spark, sf, "lineitem").filter("l_suppkey = 7").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("""SELECT r_name, n_name, c_mktsegment, count(*) AS n, count(DISTINCT o_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""")
def multi_dim_join_report(spark, sf):
    out = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = out.join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return out.groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("n_orders"))


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, previous FROM (SELECT *, lag(o_orderstatus) OVER w AS previous, row_number() OVER w AS r FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) t WHERE r = 1 OR previous IS DISTINCT FROM o_orderstatus""")
def scd2_changes(spark, sf):
    out = history.changes(read(spark, sf, "orders"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], "o_orderstatus")
    return out.select("o_orderkey", "o_custkey", "o_orderstatus", "previous")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) t WHERE r = 1""")
def latest_snapshot(spark, sf):
    return history.latest(read(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate >= TIMESTAMP '2001-03-01')")
def missing_anti(spark, sf):
    """Customers whom the latest orders don't name."""
    seen = read(spark, sf, "orders").filter("o_orderdate >= timestamp_ntz '2001-03-01'").select(F.col("o_custkey").alias("c_custkey"))
    return history.missing(read(spark, sf, "customer").select("c_custkey", "c_name"), seen, ["c_custkey"])


@query("""WITH a AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 11 <> 0),
b AS (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 13 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'deleted' WHEN a.h <> b.h THEN 'modified' ELSE 'unchanged' END AS state
FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id""")
def incremental_diff(spark, sf):
    """The new snapshot is made here: some rows are gone, some are new, some changed."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    old = docs.filter("doc_id % 11 <> 0").select("doc_id", F.md5("text").alias("h"))
    new = docs.filter("doc_id % 13 <> 0").select("doc_id", F.md5(F.expr("CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END")).alias("h"))
    return history.difference(old, new, "doc_id", "h")


@query("""SELECT conv_id, count(*) AS depth, string_agg(role, '→' ORDER BY turn, role) AS roles FROM conversations GROUP BY 1 HAVING count(*) > 1""")
def threads_depth(spark, sf):
    return history.threads(read(spark, sf, "conversations"), "conv_id", "turn", "role")


@query("""SELECT c.conv_id, c.turn, CASE WHEN c.role = 'system' THEN 'bot' WHEN p.role IS NULL THEN c.role || '_root' WHEN p.role = c.role THEN c.role || '_self' ELSE c.role || '_reply' END AS kind
FROM conversations c LEFT JOIN conversations p ON c.conv_id = p.conv_id AND c.turn = p.turn + 1""")
def comment_roles(spark, sf):
    rows = read(spark, sf, "conversations")
    parent = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("parent"))
    kind = F.when(F.col("role") == "system", "bot").when(F.col("parent").isNull(), F.concat("role", F.lit("_root"))).when(F.col("parent") == F.col("role"), F.concat("role", F.lit("_self"))).otherwise(F.concat("role", F.lit("_reply")))
    return rows.join(parent, ["conv_id", "turn"], "left").select("conv_id", "turn", kind.alias("kind"))


@query("""SELECT s.s_suppkey, s.s_name, coalesce(n, 0) AS n FROM supplier s LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) t ON s.s_suppkey = t.l_suppkey""")
def cohort_counts_zero_filled(spark, sf):
    n = read(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return read(spark, sf, "supplier").join(n, "s_suppkey", "left").select("s_suppkey", "s_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT o_orderkey, count(*) AS n, cast(sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1 HAVING count(*) >= 5""")
def having_threshold_since(spark, sf):
    """An incremental lower bound that reaches the scan, then a threshold on groups."""
    rows = read(spark, sf, "orders").filter("o_orderdate >= timestamp_ntz '1998-01-01'").join(read(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("large")).filter("n >= 5")


@query("""WITH u AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 89 <> 0 AND c_custkey % 97 <> 0 UNION ALL SELECT c_custkey, c_name || ' again', c_nationkey, c_acctbal + 1 FROM customer WHERE c_custkey % 97 = 0 AND c_custkey % 89 <> 0 UNION ALL SELECT c_custkey + 100000000, 'new', c_nationkey, c_acctbal FROM customer WHERE c_custkey % 101 = 0)
SELECT c_custkey, c_name, c_nationkey, cast(floor(c_acctbal * 100 + 0.5) AS BIGINT) AS cents FROM u""")
def bucketed_upserts(spark, sf):
    """Customers in buckets by key: a hundredth is changed, others go, and new ones come; read with the changes merged."""
    rows = read(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", F.lit(1).alias("v"))

    def build(path):
        table = B.created(rows, f"{path}/customers", ["c_custkey"], "v")
        again = rows.filter("c_custkey % 97 = 0").withColumns({"c_name": F.concat("c_name", F.lit(" again")), "c_acctbal": F.col("c_acctbal") + 1, "v": F.lit(2)})
        new = rows.filter("c_custkey % 101 = 0").withColumns({"c_custkey": F.col("c_custkey") + 100_000_000, "c_name": F.lit("new")})
        table = B.upserted(table, again.unionByName(new))
        B.deleted(table, rows.filter("c_custkey % 89 = 0").select("c_custkey"))
        return {"path": path}

    table = B.opened(spark, f"{stored(rows, 'buckets', '2', build)}/customers")
    return B.rows_of(spark, table).select("c_custkey", "c_name", "c_nationkey", F.floor(F.col("c_acctbal") * 100 + 0.5).cast("long").alias("cents"))
