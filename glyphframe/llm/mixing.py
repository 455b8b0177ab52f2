"""Mixing sources to target weights: budgets go down a tree of groups, then each leaf gives a prefix of seeded epochs.

Built-in functions only. A leaf can give its tokens max_epochs times. From the root down, each node shares its budget
among its children by weight; a child that cannot use its share passes the rest to its siblings, and only what a whole
family cannot use counts against the families beside it, since a family's capacity is the sum of its leaves'. The sharing
is solved in closed form by window functions over the small table of nodes.

A leaf's epoch is its documents in the order of a seeded hash. The place where the budget ends is found by sums over 256
hash buckets, then over 256 parts of the one bucket that the budget cuts, and only there by a sum along documents. So no
task holds a leaf, however large its share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, free_name

# The domains of sources, and the weights of nodes by path. Nodes that are not named weigh 1.
DOMAINS = {"src0": "crawl", "src1": "crawl", "src2": "forum", "src3": "forum", "src4": "forum", "src5": "forum", "src6": "forum", "src7": "forum"}
OTHER_DOMAIN = "reference"
WEIGHTS = {"crawl": 3, "forum": 2, "reference": 5, "crawl/en": 6, "crawl/de": 2, "crawl/fr": 2, "crawl/es": 4, "forum/en": 5, "reference/en": 4, "reference/es": 3, "reference/en/src8": 2, "forum/de/src5": 3}
SHARE, MAX_EPOCHS, SEED = (7, 10), 3, "glyphframe-1"


def domain(source: Column) -> Column:
    found = F.lit(OTHER_DOMAIN)
    for name, kind in DOMAINS.items():
        found = F.when(source == name, kind).otherwise(found)
    return found


def tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def share_out(nodes: DataFrame, parent: str, budget: str, out: str) -> DataFrame:
    """nodes (weight, capacity, budget of the parent) with each node's own budget; rests of divisions are left unused."""
    family = Window.partitionBy(parent)
    order = family.orderBy(F.col("capacity") / F.col("weight"), "node")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    marked = nodes.withColumn("full", F.col("capacity") * F.sum("weight").over(after) <= F.col("weight") * (F.col(budget) - F.coalesce(F.sum("capacity").over(before), F.lit(0))))
    left = F.col(budget) - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(family), F.lit(0))
    open_ = F.sum(F.when(~F.col("full"), F.col("weight"))).over(family)
    return marked.select("*", F.when(F.col("full"), F.col("capacity")).otherwise(F.call_function("div", F.col("weight") * left, open_)).cast("bigint").alias(out)).drop("full")


def budgets(leaves: DataFrame, weights: dict[str, int], total: int, max_epochs: int) -> DataFrame:
    """leaves (a, b, c, avail) with budget: the tokens that each leaf gives, repetitions included."""
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map().cast("map<string,int>")
    weight = lambda path: F.coalesce(F.try_element_at(known, path), F.lit(1)).cast("bigint")
    paths = [F.concat_ws("/", *[F.replace(F.col(x), F.lit("/"), F.lit("%2F")) for x in "abc"[:k]]) for k in (1, 2, 3)]
    rows = leaves.select("*", *[p.alias(f"p{k}") for k, p in enumerate(paths, 1)], (F.col("avail") * max_epochs).alias("room"))
    held = None
    for k in (1, 2, 3):
        parent = F.lit("") if k == 1 else F.col(f"p{k - 1}")
        nodes = rows.groupBy(F.col(f"p{k}").alias("node"), parent.alias("parent")).agg(F.sum("room").alias("capacity"))
        nodes = nodes.withColumn("weight", weight(F.col("node"))).where("weight > 0 and capacity > 0")
        if held is None:
            nodes = nodes.withColumn("above", F.lit(total).cast("bigint"))
        else:
            nodes = nodes.join(held.select(F.col("node").alias("parent"), F.col("own").alias("above")), "parent")
        held = checkpointed(share_out(nodes, "parent", "above", "own").select("node", "own"))
    return rows.join(held.withColumnRenamed("node", "p3"), "p3", "left").select(F.col("p3").alias("leaf"), "a", "b", "c", "avail", F.coalesce("own", F.lit(0)).alias("budget"))


def prefix(rows: DataFrame) -> DataFrame:
    """Of rows (leaf, unit, n, key, rest): leaf and unit of those in the first rest tokens by key, the one cut included."""
    found, edge = None, rows
    for level in (1, 2):
        bucket = F.substr("key", F.lit(2 * level - 1), F.lit(2))
        edge = edge.withColumn("bucket", bucket)
        sums = edge.groupBy("leaf", "bucket").agg(F.sum("n").alias("s"), F.first("rest").alias("most"))
        so_far = Window.partitionBy("leaf").orderBy("bucket")
        sums = checkpointed(sums.select("leaf", "bucket", "s", "most", (F.sum("s").over(so_far) - F.col("s")).alias("before")).where("before < most or before + s <= most"))
        met = edge.join(sums, ["leaf", "bucket"])
        whole = met.where("before + s <= most").select("leaf", "unit")
        found = whole if found is None else found.union(whole)
        edge = met.where("before + s > most").select("leaf", "unit", "n", "key", (F.col("most") - F.col("before")).alias("rest"))
    along = Window.partitionBy("leaf", F.substr("key", F.lit(1), F.lit(4))).orderBy("key", "unit")
    last = edge.withColumn("upto", F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return found.union(last.where("upto - n < rest or upto <= rest").select("leaf", "unit"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", weights: dict[str, int] | None = None, share: tuple[int, int] = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """(unit, a, b, c, n, copies): how often each document of each domain / language / source leaf is taken.

    The total budget is the share (a fraction) of all tokens. Null languages and sources are groups named by the empty
    text; a null id is an id like any other. Rows of one id in one leaf count as one document and go together. A leaf
    without tokens, and one of weight 0, gives nothing. Ties in the hash go to the smaller id. No rows give no rows.
    """
    weights = WEIGHTS if weights is None else weights
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))
    named = docs.select(domain(source).alias("a"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("b"), source.alias("c"), F.col(f"`{id_col}`").cast("bigint").alias("unit"), tokens(F.col(f"`{text_col}`").cast("string")).alias("n"))
    units = checkpointed(named.groupBy("a", "b", "c", "unit").agg(F.sum("n").alias("n")))
    leaves = checkpointed(units.groupBy("a", "b", "c").agg(F.sum("n").alias("avail")).where("avail > 0"))
    total = leaves.agg(F.coalesce(F.sum("avail"), F.lit(0))).first()[0] * share[0] // share[1]
    plan = checkpointed(budgets(leaves, weights, total, max_epochs).withColumn("full", F.expr("budget div avail").cast("int")).withColumn("rest", F.expr("budget - full * avail")).where("budget > 0"))
    rows = units.join(plan.drop("avail", "budget"), ["a", "b", "c"])
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("full").cast("string"), F.coalesce(F.col("unit").cast("string"), F.lit("null"))))
    some = prefix(rows.where("rest > 0").select("leaf", "unit", "n", key.alias("key"), "rest"))
    out = rows.join(some.select(F.col("leaf").alias("l"), F.col("unit").alias("u")), F.col("leaf").eqNullSafe(F.col("l")) & F.col("unit").eqNullSafe(F.col("u")), "left")
    copies = F.col("full") + F.when(F.col("l").isNotNull(), 1).otherwise(0)
    return out.select("unit", "a", "b", "c", "n", copies.alias("copies")).where("copies > 0")


def mixed_ids(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epoch): one row for each time that a document is taken."""
    return mix(docs, **options).select(F.col("unit").alias("doc_id"), F.col("a").alias("domain"), F.col("b").alias("lang"), F.col("c").alias("source"), F.col("n").alias("n_tokens"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("epoch"))


def mixed(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, each as often as it is taken; the columns of docs."""
    names = [free_name(docs.columns, x) for x in ("unit_", "lang_", "source_", "copies_")]
    taken = mix(docs, id_col=id_col, lang_col=lang_col, source_col=source_col, **options).select(*[F.col(a).alias(b) for a, b in zip(("unit", "b", "c", "copies"), names, strict=True)])
    unit, lang, source, copies = map(F.col, names)
    met = docs.join(taken, F.col(f"`{id_col}`").cast("bigint").eqNullSafe(unit) & (F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")) == lang) & (F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")) == source))
    each = free_name(docs.columns, "each_")
    return met.withColumn(each, F.explode(F.sequence(F.lit(1), copies))).select(*[F.col(f"`{x}`") for x in docs.columns])


def oracle_sql() -> str:
    """DuckDB: the same rows as query op10_mixing."""
    case = "CASE " + " ".join(f"WHEN coalesce(source, '') = '{k}' THEN '{v}'" for k, v in DOMAINS.items()) + f" ELSE '{OTHER_DOMAIN}' END"
    values = ", ".join(f"('{k}', {v})" for k, v in WEIGHTS.items())
    level = """
nodes{k} AS (
  SELECT l.p{k} AS node, {parent} AS parent, sum(room)::BIGINT AS capacity, coalesce(max(w.weight), 1)::BIGINT AS weight, max({above})::BIGINT AS above
  FROM {source} l LEFT JOIN weights w ON w.node = l.p{k} GROUP BY 1, 2
), marked{k} AS (
  SELECT *, capacity * sum(weight) OVER (PARTITION BY parent ORDER BY capacity / weight, node ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= weight * (above - coalesce(sum(capacity) OVER (PARTITION BY parent ORDER BY capacity / weight, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full
  FROM nodes{k}
), own{k} AS (
  SELECT node, CASE WHEN is_full THEN capacity ELSE ((weight * (above - coalesce(sum(capacity) FILTER (is_full) OVER (PARTITION BY parent), 0))) // (sum(weight) FILTER (NOT is_full) OVER (PARTITION BY parent))) END::BIGINT AS own
  FROM marked{k}
)"""
    return f"""
WITH weights(node, weight) AS (VALUES {values}),
units AS (
  SELECT {case} AS a, coalesce(lang, '') AS b, coalesce(source, '') AS c, doc_id AS unit, sum(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0))::BIGINT AS n
  FROM documents GROUP BY ALL
), leaves AS (
  SELECT a AS p1, a || '/' || b AS p2, a || '/' || b || '/' || c AS p3, a, b, c, sum(n)::BIGINT AS avail, (sum(n) * {MAX_EPOCHS})::BIGINT AS room FROM units GROUP BY ALL HAVING sum(n) > 0
), total AS (SELECT (sum(avail) * {SHARE[0]} // {SHARE[1]})::BIGINT AS t FROM leaves),
{level.format(k=1, parent="''", above="(SELECT t FROM total)", source="leaves")},
{level.format(k=2, parent="l.p1", above="l.own", source="(SELECT x.*, o.own FROM leaves x JOIN own1 o ON o.node = x.p1)")},
{level.format(k=3, parent="l.p2", above="l.own", source="(SELECT x.*, o.own FROM leaves x JOIN own2 o ON o.node = x.p2)")},
plan AS (
  SELECT a, b, c, own // avail AS whole, own - (own // avail) * avail AS rest FROM leaves JOIN own3 ON node = p3 WHERE own > 0
), keyed AS (
  SELECT u.*, whole, rest, md5('{SEED}:' || whole || ':' || coalesce(unit::VARCHAR, 'null')) AS key FROM units u JOIN plan USING (a, b, c)
), summed AS (
  SELECT *, sum(n) OVER (PARTITION BY a, b, c ORDER BY key, unit ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed
), copies AS (
  SELECT *, whole + CASE WHEN rest > 0 AND (upto - n < rest OR upto <= rest) THEN 1 ELSE 0 END AS copies FROM summed
)
SELECT unit AS doc_id, a AS domain, b AS lang, c AS source, n AS n_tokens, unnest(generate_series(0, copies - 1))::INTEGER AS epoch FROM copies WHERE copies > 0
"""
