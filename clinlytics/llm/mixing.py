"""Operator 5: mixing sources to target weights by hierarchical budgets, DataFrame functions only.

The tree is domain > language > source. Every node has an integer weight. A
node's budget is split over its children in proportion to their weights, but
never beyond a child's capacity (its tokens times MAX epochs); what a short
child leaves goes to its siblings first and only what a whole subtree can't
hold goes up to the parent's siblings. That is water-filling from the root
down, in exact integers. Each leaf then passes through its documents in seeded
epochs: whole epochs give every document one copy each, and the last epoch
gives the prefix, in the order of md5(seed, epoch, doc_id), whose running
token sum stays within the rest.

Scale: leaves are pre-aggregated; the running sums go over hash slices (4096 a
leaf) first and over rows only in the one slice per leaf where the budget ends,
so a source with a third of all rows is never ordered in one task. Node tables
are written, so that a join is broadcast only if their size is below the
session's threshold.

Defined results: null lang and source are nodes named ''; texts without tokens
(null, empty) are never chosen; rows that tie in id and order are chosen or
left together; a node of weight 0 gets nothing; extra columns are ignored (or
kept, for :func:`mix`).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinlytics.llm.common import prepare, written

LEVELS = ("domain", "lang", "source")
TOKEN = r"[^\x20\x09-\x0D]+"
#: hash slices of a leaf: hexadecimal digits of the order key
SLICE_DIGITS = 3
SEED = 17
MAX_EPOCHS = 2
#: the query's budget: so many percent of the tokens there are
BUDGET_PERCENT = 60

# The query's weights by node name (1 where a name isn't listed).
DOMAIN_WEIGHTS = {"d0": 3, "d1": 2, "d2": 1}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS = {"src0": 2, "src5": 3}


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)).cast("bigint"), F.lit(0))


def domain_of(source: Column) -> Column:
    """The query's domain rule: by the code of the source's last character."""
    return F.concat(F.lit("d"), (F.ascii(F.right(source, F.lit(1))) % 3).cast("string"))


def weight_of(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, v in weights.items():
        out = F.when(name == k, v).otherwise(out)
    return out.cast("bigint")


def with_tree(docs: DataFrame) -> DataFrame:
    """``docs`` with _domain, _lang, _source and _tokens."""
    source = F.coalesce("source", F.lit(""))
    return docs.withColumns({"_domain": domain_of(source), "_lang": F.coalesce("lang", F.lit("")), "_source": source, "_tokens": tokens(F.col("text"))})


def leaf_table(rows: DataFrame, weights: tuple[dict, dict, dict], epochs: int) -> DataFrame:
    """Supply, capacity and the weights of a leaf and its ancestors."""
    big = "decimal(38,0)"
    leaf = rows.where("_tokens > 0").groupBy("_domain", "_lang", "_source").agg(F.sum("_tokens").alias("supply"))
    w = [weight_of(F.col(f"_{c}"), x) for c, x in zip(LEVELS, weights, strict=True)]
    alive = (w[0] > 0) & (w[1] > 0) & (w[2] > 0)
    return leaf.select("_domain", "_lang", "_source", "supply", F.when(alive, F.col("supply") * epochs).otherwise(0).cast(big).alias("cap"),
                       *(x.cast(big).alias(f"w{i}") for i, x in enumerate(w)))


def filled(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Water-filling of ``budget`` over the children (cap, w) of each parent; adds ``share``.

    A child is full when its level cap / w is within reach of the budget that
    the shorter ones leave; the rest is split by weight, rounded down.
    """
    w = Window.partitionBy(*parent).orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), name) if parent else \
        Window.orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), name)
    before = F.coalesce(F.sum("cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = children.withColumn("_full", (F.col("cap") * rest <= (F.col("budget") - before) * F.col("w")))
    every = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    used = F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(every)
    open_w = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("w"))).over(every)
    share = F.when(F.col("_full"), F.col("cap")).otherwise(
        F.floor((F.col("budget") - used) * F.col("w") / F.when(open_w > 0, open_w)).cast("decimal(38,0)"))
    return out.withColumn("share", share.cast("decimal(38,0)")).drop("_full")


def _level(nodes: DataFrame, above: DataFrame | None, budget: Column | None, depth: int) -> DataFrame:
    parent = [f"_{c}" for c in LEVELS[:depth]]
    name = f"_{LEVELS[depth]}"
    children = nodes.where("cap > 0").groupBy(*parent, name).agg(F.sum("cap").cast("decimal(38,0)").alias("cap"), F.max(f"w{depth}").alias("w"))
    children = children.withColumn("budget", budget) if above is None else children.join(above, parent)
    total = F.sum("cap").over(Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0)))
    children = children.withColumn("budget", F.least(F.col("budget"), total).cast("decimal(38,0)"))
    return filled(children, parent, name).select(*parent, name, F.col("share").alias("budget"))


def plan(rows: DataFrame, weights: tuple[dict, dict, dict], budget_percent: int, epochs: int) -> DataFrame:
    """Per leaf: supply, budget, whole epochs and what the last epoch may take."""
    leaf = written(leaf_table(rows, weights, epochs))
    budget = F.floor(leaf.select(F.coalesce(F.sum("supply"), F.lit(0)) * budget_percent).scalar() / 100).cast("decimal(38,0)")
    by_domain = _level(leaf, None, budget, 0)
    by_lang = _level(leaf, by_domain, None, 1)
    by_source = _level(leaf, by_lang, None, 2)
    out = leaf.join(by_source, ["_domain", "_lang", "_source"]).select("_domain", "_lang", "_source", "supply", F.col("budget").cast("bigint").alias("budget"))
    epoch = F.floor(F.col("budget") / F.col("supply")).cast("bigint")
    return written(out.select("*", epoch.alias("full_epochs"), (F.col("budget") - epoch * F.col("supply")).alias("rest")))


def ordered(rows: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """Rows with their leaf's plan and their place (order key) in the last epoch."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("full_epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return (rows.where("_tokens > 0").join(leaves, ["_domain", "_lang", "_source"])
            .withColumn("_key", key).withColumn("_slice", F.substring("_key", 1, SLICE_DIGITS)))


def prefix_ends(rows: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """Per leaf: the slice in which its last epoch ends and the tokens left for it there."""
    sums = (ordered(rows, leaves, seed).groupBy("_domain", "_lang", "_source", "_slice")
            .agg(F.sum("_tokens").alias("n"), F.max("rest").alias("rest")))
    w = Window.partitionBy("_domain", "_lang", "_source").orderBy("_slice")
    upto = sums.withColumn("upto", F.sum("n").over(w)).where("upto > rest")
    return (upto.groupBy("_domain", "_lang", "_source")
            .agg(F.min(F.struct("_slice", (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))).alias("end"))
            .select("_domain", "_lang", "_source", F.col("end._slice").alias("end_slice"), F.col("end.left").alias("left")))


def mix(docs: DataFrame, weights: tuple[dict, dict, dict] = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS),
        budget_percent: int = BUDGET_PERCENT, epochs: int = MAX_EPOCHS, seed: int = SEED, narrow: DataFrame | None = None) -> DataFrame:
    """The chosen rows of ``docs`` with all their columns, domain, n_tokens and copies."""
    prepare(docs.sparkSession)
    tree = ["_domain", "_lang", "_source"]
    narrow = narrow if narrow is not None else token_table(docs)
    leaves = plan(narrow, weights, budget_percent, epochs)
    ends = written(leaves.join(prefix_ends(narrow, leaves, seed), tree, "left"))
    # Rows of the slices where a leaf's budget ends: 1 / 16^SLICE_DIGITS of the rows.
    edge = ordered(narrow, ends, seed).where("_slice = end_slice")
    w = Window.partitionBy(*tree).orderBy("_key", "doc_id")
    inside = written(edge.withColumn("_upto", F.sum("_tokens").over(w)).where("_upto <= left").select("_key", *tree).distinct()
                     .withColumn("_inside", F.lit(True)))
    full = docs if "_tokens" in docs.columns else with_tree(docs)
    rows = ordered(full, ends, seed).join(inside, ["_key", *tree], "left")
    last = F.when(F.col("end_slice").isNull() | (F.col("_slice") < F.col("end_slice")) | F.col("_inside"), 1).otherwise(0)
    rows = rows.withColumn("_copies", (F.col("full_epochs") + F.when(F.col("rest") > 0, last).otherwise(0)).cast("bigint")).where("_copies > 0")
    own = [c for c in docs.columns if not c.startswith("_") and c not in ("domain", "n_tokens", "copies")]
    return rows.select(*own, F.col("_domain").alias("domain"), F.col("_tokens").alias("n_tokens"), F.col("_copies").alias("copies"))


def token_table(docs: DataFrame) -> DataFrame:
    """doc_id with its leaf and tokens, written once."""
    return written(with_tree(docs.select("doc_id", "text", "lang", "source")).select("doc_id", "lang", "source", "_domain", "_lang", "_source", "_tokens"))


def mixture(docs: DataFrame) -> DataFrame:
    """The op5 result: doc_id, domain, lang, source, n_tokens, copies."""
    prepare(docs.sparkSession)
    narrow = token_table(docs)
    return mix(narrow, narrow=narrow).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def oracle(source: str = "documents") -> str:
    """DuckDB SQL of :func:`mixture`: the same rules with plain running sums."""
    def case(c: str, weights: dict[str, int]) -> str:
        return "CASE " + " ".join(f"WHEN {c} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"

    def level(depth: int, above: str) -> str:
        cols = ["domain", "l", "s"][:depth + 1]
        parent, name = ", ".join(cols[:-1]) or "1", cols[-1]
        using = f"JOIN {above} b USING ({', '.join(cols[:-1])})" if depth else f"CROSS JOIN {above} b"
        return f"""
      c{depth} AS (SELECT n.*, least(b.budget, sum(cap) OVER (PARTITION BY {parent})) AS budget FROM
        (SELECT {', '.join(cols)}, sum(cap)::HUGEINT AS cap, max(w{depth})::HUGEINT AS w FROM leaf GROUP BY {', '.join(cols)}) n {using}),
      f{depth} AS (SELECT *, cap * sum(w) OVER (PARTITION BY {parent} ORDER BY cap::DOUBLE / w::DOUBLE, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
          <= (budget - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap::DOUBLE / w::DOUBLE, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS full_ FROM c{depth}),
      b{depth} AS (SELECT {', '.join(cols)}, CASE WHEN full_ THEN cap ELSE
          ((budget - coalesce(sum(cap) FILTER (full_) OVER (PARTITION BY {parent}), 0)) * w)::HUGEINT // (sum(w) FILTER (NOT full_) OVER (PARTITION BY {parent}))::HUGEINT END AS budget FROM f{depth})"""

    return f"""
    WITH rows_ AS (SELECT doc_id, lang, source, coalesce(lang, '') AS l, coalesce(source, '') AS s,
        'd' || (CASE WHEN coalesce(source, '') = '' THEN 0 ELSE ascii(right(source, 1)) END % 3) AS domain,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n FROM {source}),
      leaf AS (SELECT domain, l, s, sum(n)::HUGEINT AS supply, (sum(n) * {MAX_EPOCHS})::HUGEINT AS cap,
        max({case('domain', DOMAIN_WEIGHTS)}) AS w0, max({case('l', LANG_WEIGHTS)}) AS w1, max({case('s', SOURCE_WEIGHTS)}) AS w2
        FROM rows_ WHERE n > 0 GROUP BY domain, l, s),
      root AS (SELECT (sum(supply) * {BUDGET_PERCENT})::HUGEINT // 100 AS budget FROM leaf),
      {level(0, 'root')}, {level(1, 'b0')}, {level(2, 'b1')},
      planned AS (SELECT domain, l, s, budget::HUGEINT // supply AS full_epochs, budget % supply AS rest FROM leaf JOIN b2 USING (domain, l, s)),
      keyed AS (SELECT r.*, p.full_epochs, p.rest, md5('{SEED}|' || p.full_epochs || '|' || coalesce(r.doc_id::VARCHAR, '')) AS k
        FROM rows_ r JOIN planned p USING (domain, l, s) WHERE n > 0),
      summed AS (SELECT *, sum(n) OVER (PARTITION BY domain, l, s ORDER BY k, doc_id) AS upto FROM keyed)
    SELECT doc_id, domain, lang, source, n AS n_tokens, CAST(full_epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
    FROM summed WHERE full_epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0"""
