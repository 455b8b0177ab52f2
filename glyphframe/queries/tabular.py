"""Queries over tables: joins, aggregates, windows, ranking, sets, scalars and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import relational as R
from ..operators import sequence as S
from ..operators import text as X
from ..sources import files
from .registry import query, table

# Keyword categories for documents and part names.
KEYWORDS = {"function": ["the", "that", "with"], "motion": ["tion", "ing"], "place": ["ander", "ther", "here"], "romance": ["que", "los", "les"], "german": ["und", "keit", "lich"]}
EDGES = [(0.0, 50_000.0, 1), (50_000.0, 100_000.0, 2), (100_000.0, 200_000.0, 3), (200_000.0, 400_000.0, 4)]
ROUND = 6


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """(pos, day, n, value_sum): one row a day of events."""
    by = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value_sum"))
    return by.withColumn("pos", F.row_number().over(S.over("day")))


DAILY = "daily AS (SELECT row_number() OVER (ORDER BY day) AS pos, * FROM (SELECT ts::DATE AS day, count(*) AS n, round(sum(value), 4) AS value_sum FROM events GROUP BY 1))"


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_defaults(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return R.left_with_defaults(table(spark, sf, "documents").select("doc_id"), labels, "doc_id", {"quality": -1, "toxic": 0})


@query("SELECT o_orderkey, o_totalprice, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def inner_join(spark, sf):
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf, "orders").join(customer, "o_custkey").select("o_orderkey", "o_totalprice", "c_mktsegment")


@query("""
SELECT n_nationkey AS id, n_name AS name, coalesce(r_name, 'Unknown') AS region, c.n AS customers, c.mean_balance, s.n AS suppliers, (c.n IS NOT NULL) AS has_customers
FROM nation LEFT JOIN region ON r_regionkey = n_regionkey
LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n, round(avg(c_acctbal), 4) AS mean_balance FROM customer GROUP BY 1) c ON c.k = n_nationkey
LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON s.k = n_nationkey
WHERE n_nationkey <= 72
""")
def nested_record_flat(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), "n_regionkey")
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    customers = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"))
    suppliers = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    rows = R.nested_record(nation.join(region, "n_regionkey", "left").where("id <= 72"), "id", {"customers": customers, "suppliers": suppliers})
    return rows.select("id", "name", F.coalesce("r_name", F.lit("Unknown")).alias("region"), F.col("customers.n").alias("customers"), F.col("customers.mean_balance").alias("mean_balance"), F.col("suppliers.n").alias("suppliers"), F.col("customers").isNotNull().alias("has_customers"))


# Names of numbered groups.
GROUP_NAMES = {1: "sparse", 2: "spread", 3: "loops", 5: "mixed"}
NAMED = "CASE {} WHEN 1 THEN 'sparse' WHEN 2 THEN 'spread' WHEN 3 THEN 'loops' WHEN 5 THEN 'mixed' ELSE 'Unknown' END"


@query(f"SELECT vec_id, label, {NAMED.format('label')} AS name FROM embeddings")
def cluster_names(spark, sf):
    return R.named(table(spark, sf, "embeddings").select("vec_id", "label"), "label", GROUP_NAMES, "name")


@query(f"""
WITH l AS (SELECT l_partkey AS k, count(*) AS n, max(l_quantity) AS most FROM lineitem GROUP BY 1), r AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
e AS (SELECT vec_id AS k, label FROM embeddings), d AS (SELECT doc_id AS k, lang, n_chars FROM documents), b AS (SELECT doc_id AS k, quality, toxic FROM labels)
SELECT p_partkey AS id, coalesce(p_name, 'Part ' || p_partkey) AS name, p_size AS size, l.n AS lines, l.most, r.n AS returned, e.label AS cluster, {NAMED.format('e.label')} AS cluster_name, d.lang, d.n_chars, b.quality, b.toxic,
  (l.k IS NOT NULL)::INT + (r.k IS NOT NULL)::INT + (e.k IS NOT NULL)::INT + (d.k IS NOT NULL)::INT + (b.k IS NOT NULL)::INT + 1 AS parts
FROM part LEFT JOIN l ON l.k = p_partkey LEFT JOIN r ON r.k = p_partkey LEFT JOIN e ON e.k = p_partkey LEFT JOIN d ON d.k = p_partkey LEFT JOIN b ON b.k = p_partkey
""")
def nested_record_six(spark, sf):
    """Six parts a record, each null where it is missing, with the default name of a missing group."""
    of = lambda t, key: table(spark, sf, t).withColumnRenamed(key, "id")
    lines = of("lineitem", "l_partkey")
    parts = {
        "text": of("part", "p_partkey").select("id", F.col("p_name").alias("name"), F.col("p_size").alias("size")),
        "sales": lines.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("most")),
        "returns": lines.where("l_returnflag = 'R'").groupBy("id").agg(F.count(F.lit(1)).alias("n")),
        "cluster": of("embeddings", "vec_id").select("id", "label"),
        "document": of("documents", "doc_id").select("id", "lang", "n_chars"),
        "labels": of("labels", "doc_id").select("id", "quality", "toxic"),
    }
    rows = R.nested_record(of("part", "p_partkey").select("id"), "id", parts).withColumn("label", F.col("cluster.label"))
    have = sum((F.col(p).isNotNull().cast("int") for p in parts), F.lit(0))
    return R.named(rows, "label", GROUP_NAMES, "cluster_name").select(
        "id", F.coalesce("text.name", F.concat(F.lit("Part "), F.col("id").cast("string"))).alias("name"), "text.size", F.col("sales.n").alias("lines"), "sales.most", F.col("returns.n").alias("returned"),
        F.col("label").alias("cluster"), "cluster_name", "document.lang", "document.n_chars", "labels.quality", "labels.toxic", have.alias("parts"),
    )


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def missing_ids(spark, sf):
    return R.missing(table(spark, sf, "customer"), table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def common_ids(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").intersect(table(spark, sf, "orders").select("o_custkey"))


@query("SELECT n_nationkey AS id FROM nation UNION SELECT n_regionkey FROM nation")
def pair_ends(spark, sf):
    n = table(spark, sf, "nation")
    return n.select(F.col("n_nationkey").alias("id")).union(n.select("n_regionkey")).distinct()


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def semi_join(spark, sf):
    big = table(spark, sf, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return R.present(table(spark, sf, "part").select("p_partkey"), big, "p_partkey")


@query("SELECT n_nationkey AS member, n_regionkey AS grp FROM nation")
def invert_index(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("grp"), F.col("n_nationkey").alias("member"))
    return R.invert(R.members(n, "grp", "member", "members"), "grp", "members", "member")


@query("SELECT n_regionkey AS grp, array_to_string(list_sort(list(n_nationkey)), ',') AS members FROM nation GROUP BY 1")
def group_members(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("grp"), F.col("n_nationkey").alias("member"))
    return R.members(n, "grp", "member", "m").select("grp", F.array_join("m", ",").alias("members"))


@query("SELECT cell, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN (VALUES (0.0, 50000.0, 1), (50000.0, 100000.0, 2), (100000.0, 200000.0, 3), (200000.0, 400000.0, 4)) e(lo, hi, cell) ON o_totalprice >= lo AND o_totalprice < hi GROUP BY 1")
def price_edge_bucket(spark, sf):
    return R.range_bucket(table(spark, sf, "orders"), "o_totalprice", EDGES).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT p_partkey, o_orderkey FROM orders JOIN part ON o_totalprice >= p_retailprice * 100 AND o_totalprice < p_retailprice * 100 + 20")
def range_join_prices(spark, sf):
    ranges = table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") * 100).alias("lo"), (F.col("p_retailprice") * 100 + 20).alias("hi"))
    return R.range_join(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ranges, "lo", "hi", 20.0).select("p_partkey", "o_orderkey")


@query("""
WITH e AS (SELECT user_id, event_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 14400 THEN 1 ELSE 0 END AS jump FROM events),
i AS (SELECT *, sum(jump) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e)
SELECT user_id, island::BIGINT AS island, count(*) AS n, min(event_id) AS first_event FROM i GROUP BY 1, 2
""")
def event_islands(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return R.islands(e, ["user_id"], "at", "event_id", 14_400_000_000).groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS position FROM orders")
def reading_order(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(R.Window.partitionBy("o_orderstatus").orderBy("o_orderdate", "o_orderkey")).cast("bigint").alias("position"))


@query("""
WITH r AS (SELECT p_partkey, p_brand, p_retailprice, p_size, CASE WHEN p_retailprice - lag(p_retailprice) OVER w > 2 THEN 1 ELSE 0 END AS jump FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)),
l AS (SELECT *, sum(jump) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey ROWS UNBOUNDED PRECEDING) AS line FROM r)
SELECT p_partkey, line::BIGINT AS line, row_number() OVER (PARTITION BY p_brand ORDER BY line, p_size, p_partkey) AS position FROM l
""")
def layout_lines(spark, sf):
    return R.reading_order(table(spark, sf, "part"), "p_retailprice", "p_size", "p_partkey", 2.0, ["p_brand"]).select("p_partkey", "line", F.col("position").cast("bigint").alias("position"))


@query("""
WITH p(step, param) AS (VALUES (0, 0.0), (1, 1000.0), (2, 2000.0), (3, 4000.0), (4, 6000.0), (5, 8000.0), (6, 9000.0)),
c AS (SELECT step, param::DOUBLE AS param, count(*) FILTER (c_acctbal > param) AS n FROM customer, p GROUP BY ALL)
SELECT *, (row_number() OVER (ORDER BY abs(n - 760), step) = 1)::INTEGER AS chosen FROM c
""")
def threshold_sweep(spark, sf):
    return R.sweep(table(spark, sf, "customer"), "c_acctbal", [0.0, 1000.0, 2000.0, 4000.0, 6000.0, 8000.0, 9000.0], 760)


@query("SELECT p_partkey, round(p_retailprice / p_size, 3) AS aspect FROM part WHERE p_retailprice / p_size > 100")
def suspicious_ratio(spark, sf):
    ratio = F.when(F.col("p_size") == 0, 0.0).otherwise(F.col("p_retailprice") / F.col("p_size"))
    return table(spark, sf, "part").where(ratio > 100).select("p_partkey", F.round(ratio, 3).alias("aspect"))


@query("SELECT m AS metric, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME m VALUE v) GROUP BY 1")
def metric_summary(spark, sf):
    return A.summary(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).select("metric", "min", "max", F.round("mean", ROUND).alias("mean"), F.round("std", ROUND).alias("std"))


@query("SELECT p.priority, round(avg(o_totalprice), 4) AS price FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('6-NONE')) p(priority) LEFT JOIN orders ON o_orderpriority = p.priority GROUP BY 1")
def rank_means_spine(spark, sf):
    spine = spark.createDataFrame([(x,) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE")], "priority string")
    orders = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))
    return A.group_means_on_spine(spine, orders, "priority", ["price"]).select("priority", F.round("price", 4).alias("price"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def grouped_profile(spark, sf):
    return A.group_profile(table(spark, sf, "events"), ["event_type"], "value").select("event_type", "n", F.round("mean", ROUND).alias("mean"), F.round("std", ROUND).alias("std"))


@query("SELECT c_mktsegment AS segment, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def contingency(spark, sf):
    joined = table(spark, sf, "orders").select("o_custkey", "o_orderstatus").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey")
    return A.contingency(joined, "segment", "o_orderstatus", ["F", "O", "P"])


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def value_counts(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT b.range::INTEGER AS bin, count(q) AS n FROM range(15) b LEFT JOIN (SELECT l_quantity AS q, least(floor((l_quantity - lo) / (hi - lo) * 15), 14) AS k FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)) ON k = b.range GROUP BY 1")
def value_histogram(spark, sf):
    return A.histogram(table(spark, sf, "lineitem"), "l_quantity", 15)


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def pooled_shares(spark, sf):
    return A.pooled_share(table(spark, sf, "events").select("event_type", F.lit(1).alias("k")), "event_type", "k").select("event_type", "n", F.round("share", ROUND).alias("share"))


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS share FROM c),
m AS (SELECT event_type, sum(share) / (SELECT count(DISTINCT user_id) FROM events) AS mean FROM s GROUP BY 1)
SELECT event_type, round(mean / sum(mean) OVER (), 6) AS share FROM m
""")
def pooled_vs_mean_hist(spark, sf):
    return A.mean_share(table(spark, sf, "events").select("user_id", "event_type", F.lit(1).alias("k")), "user_id", "event_type", "k").select("event_type", F.round("share", ROUND).alias("share"))


@query("SELECT event_type, round(avg((value > 50)::INT), 6) AS p FROM events GROUP BY 1")
def predicate_share(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg((F.col("value") > 50).cast("int")), ROUND).alias("p"))


@query("""
WITH q AS (SELECT o_orderpriority AS g, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
SELECT g AS priority, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, min(o_totalprice) AS low, max(o_totalprice) AS high
FROM orders JOIN q ON g = o_orderpriority WHERE o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL
""")
def boxplot_stats(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority"), "o_totalprice")
    return A.box_plot(rows, "priority", "o_totalprice").select("priority", *[F.round(x, 4).alias(x) for x in ("q1", "median", "q3")], "low", "high")


BASKET = "b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), pairs AS (SELECT x.l_partkey AS lo, y.l_partkey AS hi, count(*) AS n FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2)"


@query(f"WITH {BASKET} SELECT * FROM pairs")
def part_cooccurrence(spark, sf):
    return A.cooccurrence(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")


@query(f"WITH {BASKET} SELECT item, count(*) AS pairs, sum(n)::BIGINT AS total FROM (SELECT lo AS item, n FROM pairs UNION ALL SELECT hi, n FROM pairs) GROUP BY 1")
def item_participation(spark, sf):
    return A.participation(A.cooccurrence(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey"))


@query("""
WITH b AS (SELECT DISTINCT user_id, event_type FROM events), pairs AS (SELECT x.event_type AS lo, y.event_type AS hi, count(*) AS n FROM b x JOIN b y ON x.user_id = y.user_id AND x.event_type < y.event_type GROUP BY 1, 2),
s AS (SELECT lo AS a, hi AS b, n FROM pairs UNION ALL SELECT hi, lo, n FROM pairs), i AS (SELECT DISTINCT a FROM s)
SELECT x.a, y.a AS b, coalesce(n, 0) AS n FROM i x CROSS JOIN i y LEFT JOIN s ON s.a = x.a AND s.b = y.a
""")
def cooccurrence_matrix(spark, sf):
    return A.symmetric(A.cooccurrence(table(spark, sf, "events"), "user_id", "event_type"))


@query("""
WITH g AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md, stddev_pop(l_discount) AS sd, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp FROM lineitem),
c AS (SELECT l_returnflag AS flag, avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1),
z AS (SELECT flag, 'l_quantity' AS metric, (q - mq) / sq AS z FROM c, g UNION ALL SELECT flag, 'l_discount', (d - md) / sd FROM c, g UNION ALL SELECT flag, 'l_extendedprice', (p - mp) / sp FROM c, g)
SELECT flag, metric, round(z, 6) AS z, row_number() OVER (PARTITION BY flag ORDER BY abs(z) DESC, metric)::INTEGER AS rank, CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS direction FROM z
""")
def cluster_zscores(spark, sf):
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "flag")
    return A.distinctive(A.z_profile(rows, "flag", ["l_quantity", "l_discount", "l_extendedprice"]), "flag", 3).select("flag", "metric", F.round("z", ROUND).alias("z"), "rank", "direction")


@query("""
WITH c AS (SELECT p_brand, avg(p_size) AS a, avg(p_retailprice) AS b FROM part GROUP BY 1), d AS (SELECT p_brand, p_partkey, round(sqrt((p_size - a) ^ 2 + (p_retailprice - b) ^ 2), 6) AS distance FROM part JOIN c USING (p_brand))
SELECT p_brand, p_partkey, distance FROM d QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY distance, p_partkey) = 1
""")
def group_representative(spark, sf):
    return A.representative(table(spark, sf, "part"), "p_brand", "p_partkey", ["p_size", "p_retailprice"])


@query("WITH v AS (SELECT generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT pos, avg(v) AS mean, stddev_pop(v) AS std FROM v GROUP BY 1), s AS (SELECT *, mean * mean / sum(mean * mean) OVER () AS share FROM m) SELECT pos::INTEGER AS pos, round(mean, 6) AS mean, round(std, 6) AS std, round(share, 6) AS share, round(sum(share) OVER (ORDER BY pos), 6) AS cumulative FROM s")
def position_profile(spark, sf):
    return A.position_means(table(spark, sf, "embeddings"), "embedding").select("pos", *[F.round(x, ROUND).alias(x) for x in ("mean", "std", "share", "cumulative")])


@query("SELECT event_type, round(avg(value), 6) AS mean, round((SELECT avg(value) FROM events), 6) AS overall FROM events GROUP BY 1")
def overall_beside_groups(spark, sf):
    whole = table(spark, sf, "events").agg(F.round(F.avg("value"), ROUND).alias("overall"))
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), ROUND).alias("mean")).crossJoin(whole)  # one row


# Sequences over daily events.


@query(f"WITH {DAILY} SELECT pos, round(a, 6) AS average FROM (SELECT pos, avg(value_sum) OVER w AS a, count(*) OVER w AS k FROM daily WINDOW w AS (ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) WHERE k = 7")
def moving_avg7(spark, sf):
    return S.moving_average(daily(spark, sf), "pos", "value_sum", 3).select(F.col("pos").cast("bigint").alias("pos"), F.round("average", ROUND).alias("average"))


VARIANCE = f"WITH {DAILY}, v AS (SELECT pos, variance FROM (SELECT pos, var_pop(value_sum) OVER w AS variance, count(*) OVER w AS k FROM daily WINDOW w AS (ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING)) WHERE k = 8)"


@query(f"{VARIANCE} SELECT pos, round(variance, 4) AS variance FROM v")
def sliding_var8(spark, sf):
    return S.sliding_variance(daily(spark, sf), "pos", "value_sum", 8).select(F.col("pos").cast("bigint").alias("pos"), F.round("variance", 4).alias("variance"))


@query(f"{VARIANCE} SELECT arg_min(pos, variance) AS least, arg_max(pos, variance) AS most, CASE WHEN arg_max(variance, pos) > arg_min(variance, pos) THEN 'increasing' ELSE 'decreasing' END AS trend FROM v")
def variance_extremes(spark, sf):
    rows = S.sliding_variance(daily(spark, sf).withColumn("pos", F.col("pos").cast("bigint")), "pos", "value_sum", 8)
    return S.variance_extremes(rows, "pos")


@query("""
WITH m AS (SELECT o_custkey AS id, count(*)::DOUBLE AS n, avg(o_totalprice) AS price, max(o_totalprice) AS most FROM orders GROUP BY 1), w AS (SELECT avg(n) AS a, stddev_pop(n) AS b, avg(price) AS c, stddev_pop(price) AS d, avg(most) AS e, stddev_pop(most) AS f FROM m)
SELECT id, round(((n - a) / b + (price - c) / d + (most - e) / f) / 3, 6) AS score FROM m, w
""")
def composite_score(spark, sf):
    m = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("o_totalprice").alias("price"), F.max("o_totalprice").alias("most"))
    return S.composite(m, "id", ["n", "price", "most"]).select("id", F.round("score", ROUND).alias("score"))


@query(f"WITH {DAILY}, t AS (SELECT value_sum, CASE WHEN pos <= k THEN 'early' WHEN pos <= 2 * k THEN 'middle' ELSE 'late' END AS third FROM daily, (SELECT count(*) // 3 AS k FROM daily)) SELECT third, count(*) AS n, round(avg(value_sum), 4) AS mean FROM t GROUP BY 1")
def thirds(spark, sf):
    return S.thirds(daily(spark, sf), "pos").groupBy("third").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value_sum"), 4).alias("mean"))


@query(f"""
WITH {DAILY}, p AS (SELECT k.range::INTEGER AS lag, x.value_sum AS x, y.value_sum AS y FROM range(1, 21) k, daily x JOIN daily y ON y.pos = x.pos + k.range)
SELECT lag, round(coalesce((avg(x * y) - avg(x) * avg(y)) / (stddev_pop(x) * stddev_pop(y)), 0), 6) AS r, round(2 / sqrt((SELECT count(*) FROM daily)), 6) AS band FROM p GROUP BY 1
""")
def autocorr(spark, sf):
    return S.autocorrelation(daily(spark, sf), "pos", "value_sum", 20).select("lag", F.round("r", ROUND).alias("r"), F.round("band", ROUND).alias("band"))


CUSUM = f"WITH {DAILY}, c AS (SELECT pos, sum(d) OVER (ORDER BY pos) AS cusum FROM (SELECT pos, value_sum - avg(value_sum) OVER () AS d FROM daily))"


@query(f"{CUSUM} SELECT pos, round(cusum, 4) AS cusum FROM c")
def cusum(spark, sf):
    return S.cusum(daily(spark, sf), "pos", "value_sum").select(F.col("pos").cast("bigint").alias("pos"), F.round("cusum", 4).alias("cusum"))


@query(f"{CUSUM}, j AS (SELECT pos, round(abs(lead(cusum) OVER (ORDER BY pos) - cusum), 6) AS step FROM c) SELECT pos AS before_jump, pos + 1 AS at_jump FROM j WHERE step IS NOT NULL ORDER BY step DESC, pos LIMIT 1")
def changepoint(spark, sf):
    rows = S.cusum(daily(spark, sf).withColumn("pos", F.col("pos").cast("bigint")), "pos", "value_sum")
    return S.changepoint(rows, "pos")


@query(f"""
WITH {DAILY}, l AS (SELECT list(value_sum ORDER BY pos) AS v, count(*) AS k FROM daily),
fit AS (SELECT d.pos, v, CASE WHEN d.pos <= 5 THEN 1 WHEN d.pos > k - 5 THEN k - 10 ELSE d.pos - 5 END AS lo FROM daily d, l),
w AS (SELECT f.pos, i.range AS i, f.v[f.lo + i.range] AS y, (f.pos - f.lo - 5)::DOUBLE AS t, (i.range - 5)::DOUBLE AS x FROM fit f, range(11) i)
SELECT pos, round(sum(y * ((1958 - 110 * x * x) / (11 * 1958 - 110 * 110) + x * t / 110 + (11 * x * x - 110) / (11 * 1958 - 110 * 110) * t * t)), 4) AS smooth FROM w GROUP BY 1
""")
def savgol(spark, sf):
    return S.savitzky_golay(daily(spark, sf), "pos", "value_sum").select(F.col("pos").cast("bigint").alias("pos"), F.round("smooth", 4).alias("smooth"))


# Ranking and deduplication.


@query("SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INTEGER AS rank FROM part QUALIFY rank <= 4")
def top4_per_group(spark, sf):
    return R.top_per_group(table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 4)


@query("SELECT p_brand, floor(p_retailprice / 15)::BIGINT AS cell, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, floor(p_retailprice / 15) ORDER BY p_size DESC, p_partkey) = 1")
def motif_dedupe(spark, sf):
    rows = table(spark, sf, "part").withColumn("cell", X.floor_cell(F.col("p_retailprice"), 15))
    return R.keep_first(rows, ["p_brand", "cell"], [F.desc("p_size"), F.col("p_partkey")]).select("p_brand", "cell", "p_partkey")


@query("SELECT s_suppkey, s_acctbal, 'top' AS side, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey)::INTEGER AS rank FROM supplier QUALIFY rank <= 5 UNION ALL SELECT s_suppkey, s_acctbal, 'bottom', row_number() OVER (ORDER BY s_acctbal, s_suppkey)::INTEGER AS rank FROM supplier QUALIFY rank <= 5")
def both_ends(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return R.both_ends(rows, [F.desc("s_acctbal"), F.col("s_suppkey")], [F.asc("s_acctbal"), F.col("s_suppkey")], 5)


@query("""
WITH t AS (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer), g AS (SELECT c_nationkey, count(*) AS n, array_to_string(list(c_custkey ORDER BY r) FILTER (r <= 3), ',') AS best FROM t GROUP BY 1)
SELECT c_nationkey AS nation, n, best FROM g ORDER BY n DESC, nation LIMIT 10
""")
def nested_limits(spark, sf):
    ranked = R.top_per_group(table(spark, sf, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3)
    best = ranked.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "c_custkey"))), lambda x: x["c_custkey"].cast("string")), ",").alias("best"))
    n = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return n.join(best, "c_nationkey").select(F.col("c_nationkey").alias("nation"), "n", "best").orderBy(F.desc("n"), "nation").limit(10)


@query("SELECT p_partkey AS part, k.range::INTEGER AS slot, coalesce(t.l_quantity, 0) AS quantity FROM part CROSS JOIN range(1, 6) k LEFT JOIN (SELECT l_partkey, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS r FROM lineitem) t ON t.l_partkey = p_partkey AND t.r = k.range")
def top5_zero_filled(spark, sf):
    spine = table(spark, sf, "part").select(F.col("p_partkey").alias("part"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("slot"))
    top = R.top_per_group(table(spark, sf, "lineitem"), ["l_partkey"], [F.desc("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber")], 5, "slot")
    return spine.join(top.select(F.col("l_partkey").alias("part"), "slot", F.col("l_quantity").alias("quantity")), ["part", "slot"], "left").select("part", "slot", F.coalesce("quantity", F.lit(0.0)).alias("quantity"))


# Text, scalars and arrays.

CASES = ", ".join(f"CASE WHEN {' OR '.join(f'''contains(lower(coalesce(text, '')), '{w}')''' for w in ws)} THEN '{c}' END" for c, ws in sorted(KEYWORDS.items()))


@query(f"SELECT doc_id, array_to_string(list_filter([{CASES}], lambda x: x IS NOT NULL), ',') AS categories FROM documents")
def doc_categories(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.categories(F.col("text"), KEYWORDS), ",").alias("categories"))


@query(f"WITH c AS (SELECT n_chars, unnest(list_filter([{CASES}], lambda x: x IS NOT NULL)) AS category FROM documents) SELECT category, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM c GROUP BY 1")
def category_profile(spark, sf):
    tagged = table(spark, sf, "documents").select("n_chars", F.explode(X.categories(F.col("text"), KEYWORDS)).alias("category"))
    return tagged.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def label_counts(spark, sf):
    return X.label_map(table(spark, sf, "events"), "user_id", "event_type").select("user_id", F.explode("counts").alias("event_type", "n"))


@query("""
SELECT l_orderkey, l_linenumber, round(l_discount * 100, 1) AS r1, round(sqrt(l_quantity), 6) AS root, round(ln(l_extendedprice), 6) AS log, round(degrees(atan2(l_discount, l_tax)), 6) AS angle, least(greatest(l_quantity, 10), 40) AS clipped, floor((l_quantity - 25) / 15)::BIGINT AS cell,
  'item_' || lpad(l_linenumber::VARCHAR, 3, '0') AS name, CASE WHEN l_quantity > 25 THEN 'high' ELSE 'low' END AS label, round(l_quantity / greatest(l_linenumber, 1), 3) AS ratio
FROM lineitem
""")
def scalar_functions(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.col("l_discount") * 100, 1).alias("r1"), F.round(F.sqrt(q), 6).alias("root"), F.round(F.ln("l_extendedprice"), 6).alias("log"),
        F.round(F.degrees(F.atan2("l_discount", "l_tax")), 6).alias("angle"), X.clip(q, 10.0, 40.0).alias("clipped"), X.floor_cell(q - 25, 15).alias("cell"), F.format_string("item_%03d", "l_linenumber").alias("name"),
        F.when(q > 25, "high").otherwise("low").alias("label"), F.round(q / F.greatest("l_linenumber", F.lit(1)), 3).alias("ratio"),
    )


@query("SELECT vec_id, pos::INTEGER AS pos, round(v, 6) AS v FROM (SELECT vec_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS v FROM (SELECT vec_id, list_concat(embedding[61:64]::DOUBLE[], [0.0, 0.0, 0.0, 0.0, 0.0, 0.0]) AS a FROM embeddings))")
def array_pad(spark, sf):
    tail = F.slice("embedding", 61, 4).cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(X.fixed_length(tail, 10)).alias("pos", "v")).select("vec_id", "pos", F.round("v", 6).alias("v"))


@query("WITH c AS (SELECT user_id, list(n::DOUBLE ORDER BY event_type) AS a FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1) SELECT user_id, (generate_subscripts(a, 1) - 1)::INTEGER AS pos, round(unnest(a) / list_sum(a), 6) AS share FROM c")
def array_normalise(spark, sf):
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("n"))
    lists = counts.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "n"))), lambda x: x["n"]).alias("a"))
    return lists.select("user_id", F.posexplode(X.normalised(F.col("a"))).alias("pos", "v")).select("user_id", "pos", F.round("v", 6).alias("share"))


@query("SELECT p_partkey, p_size::DOUBLE AS size, p_retailprice AS price, round(p_size + p_retailprice, 4) AS total, 2 AS n FROM part")
def vector_concat(spark, sf):
    v = F.concat(F.array(F.col("p_size").cast("double")), F.array("p_retailprice"))
    return table(spark, sf, "part").withColumn("v", v).select("p_partkey", F.col("v")[0].alias("size"), F.col("v")[1].alias("price"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("v").alias("n"))


@query("SELECT event_id, event_type FROM events WHERE value IS NOT NULL AND props IS NOT NULL")
def non_null(spark, sf):
    return table(spark, sf, "events").where("value is not null and props is not null").select("event_id", "event_type")


@query("SELECT e.event_id, j.key AS key, j.value AS value FROM events e, LATERAL (SELECT unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || key) AS value) j")
def keyed_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@query("SELECT p_partkey, to_base64(encode(p_name)) AS name64 FROM part")
def base64_embed(spark, sf):
    return files.embed(table(spark, sf, "part"), "p_name", "name64").select("p_partkey", "name64")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def light_export(spark, sf):
    return files.light(table(spark, sf, "supplier"), ["s_acctbal"])


@query("SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
def json_documents(spark, sf):
    return files.document(table(spark, sf, "region"))
