"""Queries of vectors, clusters, tests, graphs and generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generate as G
from ..operators import graph as N
from ..operators import stats as T
from ..operators import vectors as V
from . import visual
from .registry import query, table
from .tabular import BASKET, DAILY, daily

Z = "m AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1), z AS (SELECT vec_id AS id, list((v - m) / s ORDER BY i) AS v FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) JOIN m USING (i) GROUP BY 1)"
RAW = "z AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"


def embeddings(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


@query(f"WITH {Z} SELECT a.id AS a, row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.v, b.v), 4), b.id)::INTEGER AS rank, b.id AS b, round(list_distance(a.v, b.v), 4) AS distance FROM z a JOIN z b ON a.id <> b.id QUALIFY rank <= 8")
def feature_knn_top8(spark, sf):
    return V.neighbours(V.standardised(embeddings(spark, sf), "v"), "vec_id", "v", 8)


@query(f"WITH {RAW} SELECT a.id AS a, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_distance(a.v, b.v), 4), b.id)::INTEGER AS rank, b.id AS b, round(list_cosine_distance(a.v, b.v), 4) AS distance FROM z a JOIN z b ON a.id <> b.id QUALIFY rank <= 8")
def cosine_knn_top8(spark, sf):
    return V.neighbours(embeddings(spark, sf), "vec_id", "v", 8, "cosine")


@query(f"WITH {RAW} SELECT a.id AS lo, b.id AS hi, round(list_distance(a.v, b.v), 4) AS distance FROM z a JOIN z b ON a.id < b.id ORDER BY distance, lo, hi LIMIT 10")
def closest_pairs_top10(spark, sf):
    return V.closest_pairs(embeddings(spark, sf), "vec_id", "v", 10)


@query(f"WITH {RAW} SELECT a.id AS a, b.id AS b, round(round(list_distance(a.v, b.v), 9), 4) AS d FROM z a JOIN z b ON a.id <> b.id")
def pairwise_distances(spark, sf):
    return V.distances(embeddings(spark, sf), "vec_id", "v").withColumn("d", F.round("d", 4))


@query("""
WITH x AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings), g AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS s FROM x GROUP BY 1), c AS (SELECT label, pos, avg(v) AS m FROM x GROUP BY 1, 2),
z AS (SELECT label, pos::INTEGER AS pos, round((c.m - g.m) / g.s, 6) AS z FROM c JOIN g USING (pos))
SELECT label, pos, z, row_number() OVER (PARTITION BY label ORDER BY abs(z) DESC, pos)::INTEGER AS rank FROM z QUALIFY rank <= 3
""")
def emb_zscore_cluster_profile(spark, sf):
    x = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    g = x.groupBy("pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    c = x.groupBy("label", "pos").agg(F.avg("v").alias("cm"))
    z = c.join(g, "pos").select("label", "pos", F.round((F.col("cm") - F.col("m")) / F.col("s"), 6).alias("z"))
    from ..operators.relational import top_per_group

    return top_per_group(z, ["label"], [F.desc(F.abs("z")), F.col("pos")], 3)


@query("""
WITH x AS (SELECT label, vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY 1, 2), d AS (SELECT label, vec_id, round(sqrt(sum(pow(v - m, 2))), 6) AS distance FROM x JOIN c USING (label, i) GROUP BY 1, 2)
SELECT label, vec_id, distance FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) = 1
""")
def label_representative(spark, sf):
    from ..operators.aggregates import representative

    rows = table(spark, sf, "embeddings").select("label", "vec_id", *[F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(64)])
    return representative(rows, "label", "vec_id", [f"v{i}" for i in range(64)])


@query()
def pca_coords(spark, sf):
    scores, _ = V.principal_components(V.standardised(embeddings(spark, sf), "v"), "vec_id", "v")
    return scores


@query()
def pca_loadings(spark, sf):
    return V.principal_components(V.standardised(embeddings(spark, sf), "v"), "vec_id", "v")[1]


def label_means(spark, sf):
    """One vector a brand: a table that stays small at any scale."""
    return table(spark, sf, "part").groupBy(F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint").alias("id")).agg(F.array(F.avg("p_size"), F.avg("p_retailprice") / 100, F.stddev_pop("p_size")).alias("v"))


@query()
def ward_clusters(spark, sf):
    return V.ward_clusters(V.standardised(label_means(spark, sf), "v"), "id", "v", 8)


@query()
def ward_merges(spark, sf):
    return V.ward_merges(V.standardised(label_means(spark, sf), "v"), "id", "v")


@query()
def ward_cut_height(spark, sf):
    return V.cut_height(V.ward_merges(V.standardised(label_means(spark, sf), "v"), "id", "v"), 8)


@query()
def bisecting_clusters(spark, sf):
    return V.bisecting_clusters(embeddings(spark, sf), "vec_id", "v")


# Tests.

ORDERS = "o AS (SELECT o_orderkey AS k, o_totalprice AS x, (o_orderkey * 7919) % 1000 + o_totalprice / 1000 AS y, o_orderpriority AS g FROM orders)"


def orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("x"), ((F.col("o_orderkey") * 7919) % 1000 + F.col("o_totalprice") / 1000).alias("y"), F.col("o_orderpriority").alias("g"))


@query(f"WITH {ORDERS} SELECT g, count(*) AS n, round(corr(x, y), 6) AS r FROM o GROUP BY 1")
def pearson(spark, sf):
    return T.pearson(orders(spark, sf), "x", "y", ["g"], with_p=False).withColumn("r", F.round("r", 6))


RANKED = "SELECT event_type AS g, rank() OVER (PARTITION BY event_type ORDER BY v) + (count(*) OVER (PARTITION BY event_type, v) - 1) / 2 AS rv, rank() OVER (PARTITION BY event_type ORDER BY u) + (count(*) OVER (PARTITION BY event_type, u) - 1) / 2 AS ru FROM (SELECT event_type, floor(value) AS v, user_id AS u FROM events)"


@query(f"SELECT g, count(*) AS n, round(corr(rv, ru), 6) AS rho FROM ({RANKED}) GROUP BY 1")
def spearman(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("g"), F.floor("value").alias("v"), F.col("user_id").alias("u"))
    return T.spearman(rows, "v", "u", ["g"], with_p=False).withColumn("rho", F.round("rho", 6))


@query(f"""
WITH {DAILY}, p AS (SELECT sum(sign(a.n - b.n) * sign(a.value_sum - b.value_sum)) AS s, sum((a.n = b.n)::INT) AS tx, sum((a.value_sum = b.value_sum)::INT) AS ty, count(*) AS n0 FROM daily a JOIN daily b ON a.pos < b.pos)
SELECT (SELECT count(*) FROM daily) AS n, round(s / sqrt((n0 - tx) * (n0 - ty)), 6) AS tau FROM p
""")
def kendall(spark, sf):
    return T.kendall(daily(spark, sf), "n", "value_sum", with_p=False).withColumn("tau", F.round("tau", 6))


ALL_RANKS = "r AS (SELECT event_type AS g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r FROM (SELECT event_type, floor(value) AS v FROM events{where}))"


@query(f"WITH {ALL_RANKS.format(where='')}, s AS (SELECT g, sum(r) AS s, count(*) AS m FROM r GROUP BY 1), t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY v)), n AS (SELECT count(*)::DOUBLE AS n FROM r) SELECT count(*) AS groups, sum(m)::BIGINT AS n, round((12 / (any_value(n) * (any_value(n) + 1)) * sum(s * s / m) - 3 * (any_value(n) + 1)) / (1 - any_value(t) / (pow(any_value(n), 3) - any_value(n))), 5) AS h FROM s, t, n")
def kruskal_h(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("g"), F.floor("value").alias("v"))
    return T.kruskal(rows, "g", "v", with_p=False).withColumn("h", F.round("h", 5))


@query("""
WITH k AS (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2), r AS (SELECT event_type AS g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r FROM (SELECT event_type, floor(value) AS v FROM events WHERE event_type IN (SELECT * FROM k))),
s AS (SELECT count(*) FILTER (g = f) AS n1, count(*) FILTER (g <> f) AS n2, sum(r) FILTER (g = f) AS r1 FROM r, (SELECT min(event_type) AS f FROM k)), t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY v))
SELECT n1, n2, round(r1 - n1 * (n1 + 1) / 2, 4) AS u, round((greatest(r1 - n1 * (n1 + 1) / 2, n1 * n2 - (r1 - n1 * (n1 + 1) / 2)) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - t / ((n1 + n2)::DOUBLE * (n1 + n2 - 1)))), 5) AS z FROM s, t
""")
def mannwhitney_u(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("g"), F.floor("value").alias("v"))
    two = [r.g for r in rows.select("g").distinct().orderBy("g").limit(2).collect()]
    return T.mann_whitney(rows, "g", "v", two[0], two[1], with_p=False).select("n1", "n2", F.round("u", 4).alias("u"), F.round("z", 5).alias("z"))


@query("WITH c AS (SELECT c_mktsegment AS a, o_orderpriority AS b, count(*)::DOUBLE AS o FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), e AS (SELECT c.*, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM c) SELECT round(sum(pow(o - e, 2) / e), 5) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof, sum(o)::BIGINT AS n FROM e")
def chi2_stat(spark, sf):
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("a"))
    joined = table(spark, sf, "orders").select("o_custkey", F.col("o_orderpriority").alias("b")).join(customer, "o_custkey")
    return T.chi_square(joined, "a", "b", with_p=False).withColumn("chi2", F.round("chi2", 5))


@query(f"WITH {ORDERS} SELECT count(*) AS n, round(regr_slope(y, x), 8) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(corr(x, y), 6) AS r FROM o")
def linreg(spark, sf):
    return T.linear_fit(orders(spark, sf), "x", "y", with_p=False).select("n", F.round("slope", 8).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r", 6).alias("r"))


# Probabilities in SQL: Student's density is added up by Simpson's rule; four degrees of chi-square have a closed form.
STUDENT = """area AS (SELECT test, t, df, 1 - 2 * sum(w * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * pow(1 + x * x / df, -(df + 1) / 2)) AS p
  FROM (SELECT test, t, df, abs(t) * i.range / 4000 AS x, abs(t) / 4000 / 3 * CASE WHEN i.range IN (0, 4000) THEN 1 WHEN i.range % 2 = 1 THEN 4 ELSE 2 END AS w FROM tests, range(4001) i) GROUP BY ALL)"""


@query(f"""
WITH {DAILY}, {ALL_RANKS.format(where='')}, m AS (SELECT count(*)::DOUBLE AS n, corr(n, value_sum) AS r, corr(pos, value_sum) AS l FROM daily),
k AS (SELECT corr(a, b) AS rho FROM (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS a, rank() OVER (ORDER BY value_sum) + (count(*) OVER (PARTITION BY value_sum) - 1) / 2 AS b FROM daily)),
c AS (SELECT 'pearson' AS test, r AS c, n FROM m UNION ALL SELECT 'linear', l, n FROM m UNION ALL SELECT 'spearman', rho, n FROM k, m),
tests AS (SELECT test, c * sqrt((n - 2) / (1 - c * c)) AS t, n - 2 AS df FROM c), {STUDENT},
s AS (SELECT g, sum(r) AS s, count(*) AS m FROM r GROUP BY 1), tie AS (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY v)), all_ AS (SELECT count(*)::DOUBLE AS n FROM r),
h AS (SELECT (12 / (any_value(n) * (any_value(n) + 1)) * sum(s * s / m) - 3 * (any_value(n) + 1)) / (1 - any_value(t) / (pow(any_value(n), 3) - any_value(n))) AS h FROM s, tie, all_)
SELECT test, round(p, 6) AS p, p < 0.05 AS significant FROM (SELECT test, p FROM area UNION ALL SELECT 'kruskal', exp(-h / 2) * (1 + h / 2) FROM h)
""")
def test_probabilities(spark, sf):
    d, e = daily(spark, sf), table(spark, sf, "events").select(F.col("event_type").alias("g"), F.floor("value").alias("v"))
    rows = [
        T.pearson(d, "n", "value_sum").select(F.lit("pearson").alias("test"), "p"), T.spearman(d, "n", "value_sum").select(F.lit("spearman"), "p"),
        T.kruskal(e, "g", "v").select(F.lit("kruskal"), "p"), T.linear_fit(d, "pos", "value_sum").select(F.lit("linear"), "p"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.withColumn("significant", T.significant("p")).withColumn("p", F.round("p", 6))


# Kendall's and Mann and Whitney's probabilities are normal ones; the density is added up in the same way.
NORMAL = "1 - 2 * (SELECT sum(least(abs(z), 12) / 4000 / 3 * CASE WHEN i.range IN (0, 4000) THEN 1 WHEN i.range % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(least(abs(z), 12) * i.range / 4000, 2) / 2) / sqrt(2 * pi())) FROM range(4001) i)"


@query(f"""
WITH {DAILY}, p AS (SELECT sum(sign(a.n - b.n) * sign(a.value_sum - b.value_sum))::DOUBLE AS s FROM daily a JOIN daily b ON a.pos < b.pos),
x AS (SELECT sum(t * (t - 1) / 2) AS n, sum(t * (t - 1) * (2 * t + 5)) AS v, sum(t * (t - 1) * (t - 2)) AS w FROM (SELECT count(*)::DOUBLE AS t FROM daily GROUP BY n)),
y AS (SELECT sum(t * (t - 1) / 2) AS n, sum(t * (t - 1) * (2 * t + 5)) AS v, sum(t * (t - 1) * (t - 2)) AS w FROM (SELECT count(*)::DOUBLE AS t FROM daily GROUP BY value_sum)),
c AS (SELECT count(*)::DOUBLE AS n FROM daily),
z AS (SELECT s / sqrt((c.n * (c.n - 1) * (2 * c.n + 5) - x.v - y.v) / 18 + x.n * y.n * 2 / (c.n * (c.n - 1)) + x.w * y.w / (9 * c.n * (c.n - 1) * (c.n - 2))) AS z FROM p, x, y, c)
SELECT round(z, 5) AS z, round({NORMAL}, 6) AS p FROM z
""")
def kendall_p(spark, sf):
    return T.kendall(daily(spark, sf), "n", "value_sum", keep_z=True).select(F.round("z", 5).alias("z"), F.round("p", 6).alias("p"))


# Graphs: parts that stand in one order together.

EDGES = f"{BASKET}, bi AS (SELECT lo AS src, hi AS dst FROM pairs UNION ALL SELECT hi, lo FROM pairs)"


def edges(spark, sf):
    from ..operators.aggregates import cooccurrence

    pairs = cooccurrence(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")
    return pairs.select(F.lit(0).alias("graph"), F.col("lo").alias("src"), F.col("hi").alias("dst"), F.col("n").alias("weight"))


@query(f"WITH {EDGES}, d AS (SELECT src, count(*) AS d FROM bi GROUP BY 1) SELECT count(*) AS n_nodes, (sum(d) / 2)::BIGINT AS n_edges, round(avg(d), 6) AS avg_degree, max(d) AS max_degree, round(sum(d) / (count(*) * (count(*) - 1)), 8) AS density FROM d")
def graph_degree(spark, sf):
    return N.metrics(edges(spark, sf)).select("n_nodes", "n_edges", F.round("avg_degree", 6).alias("avg_degree"), "max_degree", F.round("density", 8).alias("density"))


COMPONENTS = "cc(node, component) USING KEY (node) AS (SELECT DISTINCT src, src FROM bi UNION (SELECT u.node, min(v.component) FROM recurring.cc u JOIN bi e ON e.src = u.node JOIN cc v ON v.node = e.dst WHERE v.component < u.component GROUP BY u.node))"


@query(f"WITH RECURSIVE {EDGES}, {COMPONENTS} SELECT node, component FROM cc")
def graph_components(spark, sf):
    return N.components(edges(spark, sf)).select("node", "component")


# Customers next to each other by number who have the same nation, segment and whole thousands of balance: many small components.
ALIKE = "c AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS m, floor(c_acctbal / 1000) AS b FROM customer), o AS (SELECT k, n, m, b, lead(k) OVER (PARTITION BY n, m, b ORDER BY k) AS next FROM c), bi AS (SELECT k AS src, next AS dst FROM o WHERE next - k < 400 UNION ALL SELECT next, k FROM o WHERE next - k < 400)"


@query(f"WITH RECURSIVE {ALIKE}, {COMPONENTS} SELECT node, component FROM cc")
def graph_many_components(spark, sf):
    from pyspark.sql import Window

    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("src"), F.lead("c_custkey").over(Window.partitionBy("c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 1000)).orderBy("c_custkey")).alias("dst"))
    return N.components(c.where("dst - src < 400").select(F.lit(0).alias("graph"), "src", "dst")).select("node", "component")


SMALL = "e AS (SELECT DISTINCT n_regionkey AS graph, least(a, b) AS src, greatest(a, b) AS dst FROM (SELECT n_regionkey, n_nationkey AS a, lead(n_nationkey, k.range) OVER (PARTITION BY n_regionkey, k.range ORDER BY n_nationkey) AS b FROM nation, range(1, 3) k) WHERE b IS NOT NULL AND (a + b) % 3 <> 0), bi AS (SELECT graph, src, dst FROM e UNION SELECT graph, dst, src FROM e)"
HOPS = f"{SMALL}, walk(graph, a, b, d) AS (SELECT graph, src, src, 0 FROM bi UNION SELECT w.graph, w.a, e.dst, w.d + 1 FROM walk w JOIN bi e ON e.graph = w.graph AND e.src = w.b WHERE w.d < 12), hops AS (SELECT graph, a, b, min(d) AS d FROM walk GROUP BY 1, 2, 3)"


def region_graphs(spark, sf):
    from pyspark.sql import Window

    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("graph"), F.col("n_nationkey").alias("a"))
    w = Window.partitionBy("graph").orderBy("a")
    n = n.select("graph", "a", F.lead("a", 1).over(w).alias("next"), F.lead("a", 2).over(w).alias("after"))
    e = n.select("graph", "a", F.explode(F.array("next", "after")).alias("b"))
    return e.where("b is not null and (a + b) % 3 <> 0").select("graph", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.lit(1.0).alias("weight")).distinct()


@query(f"""
WITH RECURSIVE {HOPS}, c AS (SELECT graph, a, min(b) AS root, max(d) AS far, count(*) AS size FROM hops GROUP BY 1, 2), big AS (SELECT graph, root, max(far) AS diameter, any_value(size) AS size FROM c GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY graph ORDER BY any_value(size) DESC, root) = 1),
b AS (SELECT graph, sum(d - 1) FILTER (d > 0) AS s, count(DISTINCT a) AS n FROM hops GROUP BY 1)
SELECT graph, diameter::INTEGER AS diameter, round(CASE WHEN n > 2 THEN s / (n * (n - 1) * (n - 2)) ELSE 0 END, 6) AS betweenness FROM big JOIN b USING (graph)
""")
def graph_diameter(spark, sf):
    return N.small_graphs(region_graphs(spark, sf)).withColumn("betweenness", F.round("betweenness", 6))


@query(f"WITH {EDGES}, d AS (SELECT src, count(*) AS d FROM bi GROUP BY 1), t AS (SELECT a.src, count(*) AS t FROM bi a JOIN bi b ON b.src = a.src AND a.dst < b.dst JOIN bi c ON c.src = a.dst AND c.dst = b.dst GROUP BY 1) SELECT round(avg(CASE WHEN d > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END), 6) AS clustering FROM d LEFT JOIN t USING (src)")
def graph_clustering(spark, sf):
    return N.clustering(edges(spark, sf)).select(F.round("clustering", 6).alias("clustering"))


@query()
def laplacian_spectrum(spark, sf):
    return N.spectra(region_graphs(spark, sf))


@query()
def stroke_graph_metrics(spark, sf):
    nodes, e = visual.traced_nodes(spark, sf), visual.traced_graph(spark, sf)
    return N.metrics(e.withColumnRenamed("img_id", "graph"), nodes.withColumnRenamed("img_id", "graph"))


@query()
def spectral_knn(spark, sf):
    e = visual.traced_graph(spark, sf).withColumnRenamed("img_id", "graph")
    return V.neighbours(N.spectra(e), "graph", "eigenvalues", 8)


# Generation.


@query("""
WITH h AS (SELECT user_id, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS share FROM events GROUP BY 1, 2), p AS (SELECT event_type, sum(share) / (SELECT count(DISTINCT user_id) FROM events) AS p FROM h GROUP BY 1)
SELECT round((SELECT avg(value) FROM events), 4) AS mean, round((SELECT stddev_pop(value) FROM events), 4) AS std, round((SELECT avg((value / 100 > 0.5)::INT) FROM events), 6) AS symmetry_probability, round((SELECT avg((value > 0)::INT) FROM events), 6) AS hole_probability, round(max(p / total), 6) AS top_angle, (SELECT count(DISTINCT event_type) FROM events) AS terminals FROM p, (SELECT sum(p) AS total FROM p)
""")
def grammar_params(spark, sf):
    e = table(spark, sf, "events").withColumn("share", F.col("value") / 100)
    counts = e.groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    g = G.learn(e, counts, e.groupBy(F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("n")), ["value"], "share", "value")
    return g.select(F.round("value.mean", 4).alias("mean"), F.round("value.std", 4).alias("std"), F.round("symmetry_probability", 6).alias("symmetry_probability"), F.round("hole_probability", 6).alias("hole_probability"), F.round(F.array_max("angle_probabilities"), 6).alias("top_angle"), F.size("terminal_probabilities").cast("bigint").alias("terminals"))


@query("SELECT o_orderkey, CASE WHEN u < 0.5 THEN 'simple' WHEN u < 0.8 THEN 'filled' ELSE 'circle' END AS kind FROM (SELECT o_orderkey, ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 5))::BIGINT / 1048576 AS u FROM orders)")
def categorical_sample(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", G.categorical(G.hashed_uniform(F.col("o_orderkey")), [("simple", 0.5), ("filled", 0.3), ("circle", 0.2)]).alias("kind"))


GRAMMAR = {"angle_probabilities": [0.27, 0.04, 0.05, 0.06, 0.05, 0.05, 0.2, 0.05, 0.05, 0.06, 0.06, 0.06], "terminal_probabilities": {"simple": 0.78, "filled/cross": 0.17, "circle": 0.04, "vertical_bar": 0.01}, "symmetry_probability": 0.11, "hole_probability": 0.53}


@query()
def generated_strokes(spark, sf):
    return G.generate(spark, GRAMMAR)


@query()
def generated_comparison(spark, sf):
    """(metric, kind, n, mean, std) of generated and real drawings: box dimension, junctions, ends and holes."""
    from ..operators import raster as R
    from ..operators import shapes as P

    def measured(masks, kind):
        thin = P.skeletons(masks)
        rows = P.topology(masks).select("img_id", F.col("nested").alias("holes")).join(R.junctions(thin).select("img_id", "junctions", "endpoints"), "img_id").join(R.box_dimension(masks).select("img_id", "dimension"), "img_id")
        return rows.select(F.lit(kind).alias("kind"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in ("dimension", "junctions", "endpoints", "holes")])).alias("x")).select("kind", "x.*")

    drawn = G.rasterise(G.generate(spark, GRAMMAR)).withColumn("px", R.ink(F.col("px")))
    both = measured(visual.masks(spark, sf), "real").union(measured(R.opening(drawn, 2), "generated"))
    return both.groupBy("metric", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"))


# Each Laplacian's eigenvalues add up to the sum of degrees, and their squares to the squares of degrees and links.
@query(f"WITH {SMALL}, d AS (SELECT graph, src, count(*) AS d FROM bi GROUP BY 1, 2) SELECT graph, round(sum(d)::DOUBLE, 2) AS trace, round(sum(d * d + d)::DOUBLE, 1) AS squares FROM d GROUP BY 1")
def laplacian_trace(spark, sf):
    v = F.col("eigenvalues")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, e: s + e)
    return N.spectra(region_graphs(spark, sf)).select("graph", F.round(total(v), 2).alias("trace"), F.round(total(F.transform(v, lambda e: e * e)), 1).alias("squares"))


@query("WITH c AS (SELECT c_mktsegment AS a, o_orderpriority AS b, count(*) AS o FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) SELECT a, b, o AS observed, round(sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER (), 6) AS expected FROM c")
def chi2_expected(spark, sf):
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("a"))
    joined = table(spark, sf, "orders").select("o_custkey", F.col("o_orderpriority").alias("b")).join(customer, "o_custkey")
    return T.expected_counts(joined, "a", "b").withColumn("expected", F.round("expected", 6))
