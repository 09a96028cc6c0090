"""Mixing sources to target weights by hierarchical budgeting.

Sources form a tree: domain, language, source.  A token budget runs down it by weight.  A node can give at
most ``epochs`` times its tokens; what it lacks is shared by its siblings in proportion to their weights,
and only what a whole family lacks goes up to the family's own siblings.  Every leaf then gives whole
epochs and a prefix, in an order seeded by epoch, that fits its budget.

The tree has one row per leaf.  Prefixes are cut in two steps: token sums by range of the seeded order, which
are combined before they are shuffled, and running sums inside the one range where a leaf's budget ends.  So
no leaf is gathered, however large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

EPOCHS, SHARE, SEED = 2, 0.8, 7
RANGE_DIGITS = 3
DOMAINS = {"src1": "books", "src2": "books", "src3": "reference", "src4": "reference"}
OTHER = "web"
DOMAIN_WEIGHTS = {"web": 0.5, "books": 0.3, "reference": 0.2}
LANG_WEIGHTS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
LEAF = ["domain_", "lang_", "source_"]


def _choice(key: Column, table: dict[str, str | float], other) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(other)) if table else F.lit(other)


def tokens(text: Column) -> Column:
    """Words between white space; 0 of a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _fill(df: DataFrame, family: list[str], child: str) -> DataFrame:
    """Adds budget to rows of (family, child, weight, capacity, given): weights up to capacity."""
    ratio = F.col("capacity") / F.col("weight")
    up = Window.partitionBy(*family).orderBy(ratio, child)
    down = Window.partitionBy(*family).orderBy(ratio.desc(), F.col(child).desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*family)
    df = df.where("weight > 0")
    df = df.withColumn("before", F.coalesce(F.sum("capacity").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("rest", F.sum("weight").over(down))
    df = df.withColumn("full", F.col("capacity") / F.col("weight") <= (F.col("given") - F.col("before")) / F.col("rest"))
    df = df.withColumn("spent", F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0.0)).over(whole)).withColumn("open", F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)).over(whole))
    budget = F.when(F.col("full"), F.col("capacity")).otherwise(F.col("weight") * (F.col("given") - F.col("spent")) / F.nullif("open", F.lit(0.0)))
    return df.withColumn("budget", budget).drop("before", "rest", "full", "spent", "open", "given")


def budgets(leaves: DataFrame, share: float, epochs: int, domain_weights: dict, lang_weights: dict) -> DataFrame:
    """Leaf columns and budget (tokens, double) from (leaf, tokens).  Sources of a family weigh alike."""
    cap = (F.col("tokens") * epochs).cast("double")
    leaf = leaves.where("tokens > 0").select(*LEAF, cap.alias("capacity"))
    lang = leaf.groupBy("domain_", "lang_").agg(F.sum("capacity").alias("capacity"))
    domain = lang.groupBy("domain_").agg(F.sum("capacity").alias("capacity"))
    total = leaf.agg(F.floor(F.sum("capacity") * (share / epochs)).cast("double").alias("given"))
    # One row of totals, and one row per domain.
    top = _fill(domain.crossJoin(F.broadcast(total)).withColumn("weight", _choice(F.col("domain_"), domain_weights, 1.0)).withColumn("all_", F.lit(0)), ["all_"], "domain_")
    mid = lang.withColumn("weight", _choice(F.col("lang_"), lang_weights, 1.0)).join(top.select("domain_", F.col("budget").alias("given")), "domain_")
    mid = _fill(mid, ["domain_"], "lang_")
    low = leaf.withColumn("weight", F.lit(1.0)).join(mid.select("domain_", "lang_", F.col("budget").alias("given")), ["domain_", "lang_"])
    return _fill(low, ["domain_", "lang_"], "source_").select(*LEAF, "budget")


def mix(
    docs: DataFrame,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: int = SEED,
    domains: dict[str, str] = DOMAINS,
    domain_weights: dict[str, float] = DOMAIN_WEIGHTS,
    lang_weights: dict[str, float] = LANG_WEIGHTS,
) -> DataFrame:
    """The rows of docs chosen, with domain_, n_tokens_ and epoch_ (from 0): a row is there once per epoch in which it is chosen.

    ``share`` of all tokens is the whole budget.  A null lang or source is an empty one; a null text has no
    tokens and comes with its neighbours in the order.  Rows with a null doc_id take their place as id ''.
    Repeated rows count each.  Weights that are not given are 1; a weight of 0 leaves a branch out.  Input
    columns named like the added ones are replaced.
    """
    spark = docs.sparkSession
    plain = common.without(docs, *LEAF, "n_tokens_", "epoch_", "order_", "range_", "edge_", "room_", "full_")
    rows = plain.withColumns(
        {
            "source_": F.coalesce(F.col("source").cast("string"), F.lit("")),
            "lang_": F.coalesce(F.col("lang").cast("string"), F.lit("")),
            "n_tokens_": tokens(F.col("text")),
        }
    ).withColumn("domain_", _choice(F.col("source_"), domains, OTHER))
    order = lambda epoch: F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    path = common.fresh_path(spark, "mixing")
    rows.select(*LEAF, "n_tokens_", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch_"), "doc_id").withColumn(
        "range_", F.substring(order(F.col("epoch_")), 1, RANGE_DIGITS)
    ).groupBy(*LEAF, "epoch_", "range_").agg(F.sum("n_tokens_").alias("tokens")).write.parquet(f"{path}/ranges")
    ranges = spark.read.parquet(f"{path}/ranges")
    leaves = ranges.where("epoch_ = 0").groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"))
    given = budgets(leaves, share, epochs, domain_weights, lang_weights).join(leaves, LEAF)
    given = given.withColumn("budget", F.floor(F.col("budget") + 1e-6).cast("long")).where("budget > 0")
    given = given.withColumn("full_", F.floor(F.col("budget") / F.col("tokens")).cast("int")).withColumn("part", F.col("budget") - F.col("full_") * F.col("tokens"))
    # Where the last, partial epoch ends: a range, and the tokens that fit inside it.
    sums = ranges.join(given.select(*LEAF, "full_", "part"), LEAF).where("epoch_ = full_ and part > 0")
    upto = Window.partitionBy(*LEAF).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("tokens").over(upto), F.lit(0))).where("before <= part and part < before + tokens")
    edge = sums.select(*LEAF, F.col("range_").alias("edge_"), (F.col("part") - F.col("before")).alias("room_"))
    given.select(*LEAF, "full_").join(edge, LEAF, "left").write.parquet(f"{path}/edges")
    edges = spark.read.parquet(f"{path}/edges")

    offered = rows.join(edges, LEAF).withColumn("epoch_", F.explode(F.sequence(F.lit(0), F.least("full_", F.lit(epochs - 1)))))
    offered = offered.withColumn("order_", order(F.col("epoch_"))).withColumn("range_", F.substring("order_", 1, RANGE_DIGITS))
    sure = offered.where((F.col("epoch_") < F.col("full_")) | (F.col("range_") < F.col("edge_")))
    last = offered.where((F.col("epoch_") == F.col("full_")) & (F.col("range_") == F.col("edge_")))
    run = Window.partitionBy(*LEAF, "epoch_").orderBy("order_", "doc_id", "n_tokens_").rowsBetween(Window.unboundedPreceding, 0)
    fitting = last.withColumn("sum_", F.sum("n_tokens_").over(run)).where("sum_ <= room_").drop("sum_")
    return sure.unionByName(fitting).select(*plain.columns, "domain_", "n_tokens_", "epoch_")


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """mix() with the columns of docs alone."""
    return mix(docs, **params).select(docs.columns)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    chosen = mix(common.table(spark, sf_dir, "documents"))
    return chosen.select("doc_id", F.col("domain_").alias("domain"), "lang", "source", F.col("epoch_").alias("epoch"), F.col("n_tokens_").alias("n_tokens"))


def _filled(name: str, source: str, family: str, child: str) -> str:
    return f"""
{name}_a AS (SELECT *, coalesce(sum(capacity) OVER (PARTITION BY {family} ORDER BY capacity / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (PARTITION BY {family} ORDER BY capacity / weight DESC, {child} DESC ROWS UNBOUNDED PRECEDING) AS rest FROM {source} WHERE weight > 0),
{name}_b AS (SELECT *, capacity / weight <= (given - before) / rest AS is_full FROM {name}_a),
{name} AS (SELECT *, CASE WHEN is_full THEN capacity ELSE weight * (given - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER (PARTITION BY {family}))
    / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY {family}) END AS budget FROM {name}_b)"""


def _cases(column: str, table: dict, other: str) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE"
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in table.items()) + f" ELSE {other} END"


ORACLE = f"""
WITH r AS (SELECT doc_id, lang, source, coalesce(lang, '') AS l, coalesce(source, '') AS s, {_cases("coalesce(source, '')", DOMAINS, f"'{OTHER}'")} AS d,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n FROM documents),
leaf AS (SELECT d, l, s, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n) * {EPOCHS} AS DOUBLE) AS capacity, 1.0::DOUBLE AS weight FROM r GROUP BY ALL HAVING sum(n) > 0),
top_in AS (SELECT d, 0 AS u, sum(capacity) AS capacity, {_cases("d", DOMAIN_WEIGHTS, "1.0::DOUBLE")} AS weight, (SELECT floor(sum(capacity) * {SHARE / EPOCHS}::DOUBLE) FROM leaf) AS given FROM leaf GROUP BY d),
{_filled("top", "top_in", "u", "d")},
mid_in AS (SELECT x.d, x.l, x.capacity, {_cases("x.l", LANG_WEIGHTS, "1.0::DOUBLE")} AS weight, t.budget AS given FROM (SELECT d, l, sum(capacity) AS capacity FROM leaf GROUP BY d, l) x JOIN top t USING (d)),
{_filled("mid", "mid_in", "d", "l")},
low_in AS (SELECT f.d, f.l, f.s, f.capacity, f.weight, f.tokens, m.budget AS given FROM leaf f JOIN mid m USING (d, l)),
{_filled("low", "low_in", "d, l", "s")},
b AS (SELECT d, l, s, tokens, CAST(floor(budget + 1e-6) AS BIGINT) AS budget FROM low),
o AS (SELECT r.*, b.budget, b.tokens, e.epoch, md5('{SEED}:' || e.epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
    FROM r JOIN b USING (d, l, s) CROSS JOIN (SELECT CAST(range AS INTEGER) AS epoch FROM range({EPOCHS})) e),
c AS (SELECT *, epoch * tokens + sum(n) OVER (PARTITION BY d, l, s, epoch ORDER BY k, doc_id, n ROWS UNBOUNDED PRECEDING) AS upto FROM o)
SELECT doc_id, d AS domain, lang, source, epoch, n AS n_tokens FROM c WHERE upto <= budget AND budget > 0
"""
