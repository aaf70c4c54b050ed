"""Mixing sources to target weights by hierarchical budgeting.

Leaves of the tree are (domain, language, source). Token counts are summed from the leaves up. From the
root down, each node's budget is dealt to its children by weight; a child can't get more than its
subtree holds (in ``max_epochs`` passes), and what it can't use goes to its siblings, again by weight.
Only what all siblings together can't use was never given to their parent: it went to the parent's
siblings. A leaf spends its budget on whole epochs and a token-prefix of one more, in an order seeded
by epoch.

Everything is aggregation and windows over the leaves. The prefix of a leaf that holds a third of all
rows isn't a window over its rows: tokens are summed in 2**BUCKET_BITS ranges of the order's hash, the
range in which the budget ends is found from the sums, and only that range is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, left_join_by_key, whole_text

LEVELS = ("domain", "lang", "source")
BUCKET_BITS = 12
SEED = 11


def words(text: str | Column = "text") -> Column:
    """Tokens as words between white space."""
    return F.regexp_count(whole_text(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def water_fill(children: DataFrame, parent: list[str]) -> DataFrame:
    """``children`` (parent columns, weight, supply, given: the parent's budget) with ``budget``.

    In order of supply / weight, a child takes its supply while that is below its share of what is left,
    the others share by weight. Children without weight get nothing."""
    ratio = F.when(F.col("weight") > 0, F.col("supply") / F.col("weight")).otherwise(F.lit(float("inf")))
    order = Window.partitionBy(*parent).orderBy("__ratio")
    every = Window.partitionBy(*parent)
    ranked = children.withColumn("__ratio", ratio).withColumn("__weights", F.sum("weight").over(every))
    # Sums over smaller ratios only, so that equal children are treated alike.
    peers = Window.partitionBy(*parent, "__ratio")
    upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranked.withColumn("__taken", F.sum("supply").over(upto) - F.sum("supply").over(peers)).withColumn(
        "__rest", F.col("__weights") - (F.sum("weight").over(upto) - F.sum("weight").over(peers))
    )
    level = (F.col("given") - F.col("__taken")) / F.col("__rest")
    full = F.coalesce((F.col("weight") > 0) & (level >= F.col("__ratio")), F.lit(False))
    # The level is that of the first child that isn't filled; filled ones come before it.
    ranked = ranked.withColumn("__full", full).withColumn("__level", F.when(~full & (F.col("weight") > 0), level))
    level = F.coalesce(F.min_by("__level", F.when(F.col("__level").isNotNull(), F.col("__ratio"))).over(every), F.lit(0.0))
    budget = F.when(F.col("__full"), F.col("supply").cast("double")).otherwise(
        F.least(F.col("supply").cast("double"), F.greatest(level, F.lit(0.0)) * F.col("weight"))
    )
    return ranked.withColumn("budget", budget).drop("__ratio", "__weights", "__taken", "__rest", "__full", "__level")


def leaf_budgets(leaves: DataFrame, weights: dict[tuple[str, ...], float], total: float) -> DataFrame:
    """``leaves`` (domain, lang, source, supply) with ``budget``. ``weights``: of paths such as ("web",) or
    ("web", "en"); a path that isn't listed weighs 1 beside its siblings."""
    spark = leaves.sparkSession
    level = leaves.select(F.lit(0).alias("__root"), F.lit(float(total)).alias("given"), *LEVELS, "supply")
    parent = ["__root"]
    for depth, name in enumerate(LEVELS, 1):
        path = [*parent, name]
        listed = [(*p, float(w)) for p, w in weights.items() if len(p) == depth]
        nodes = level.groupBy(*path).agg(F.sum("supply").alias("supply"), F.first("given").alias("given"))
        if listed:
            schema = ", ".join(f"{c} string" for c in LEVELS[:depth]) + ", weight double"
            known = F.broadcast(spark.createDataFrame(listed, schema))  # the caller's own parameter
            nodes = nodes.join(known, list(LEVELS[:depth]), "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        else:
            nodes = nodes.withColumn("weight", F.lit(1.0))
        filled = water_fill(nodes, parent).select(*path, F.col("budget").alias("given"))
        level = level.drop("given").join(filled, path)
        parent = path
    return level.select(*LEVELS, "supply", F.floor(F.col("given") + 1e-6).cast("long").alias("budget"))


def _leaf(row: str = "") -> Column:
    return F.to_json(F.array(*[F.col(row + c) for c in LEVELS]))


def _order(epoch: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), epoch.cast("int"), F.col("id"))


def _bucket() -> Column:
    return F.shiftrightunsigned("__hash", 64 - BUCKET_BITS)


def plan(rows: DataFrame, weights: dict[tuple[str, ...], float], share: float, max_epochs: int, seed: int = SEED) -> DataFrame:
    """``rows`` (id, domain, lang, source, tokens) to one row a leaf: leaf, n, tokens, supply, budget, epochs
    (whole ones), rest (tokens of the partial one) and where that ends: bucket, last_hash, last_id."""
    sums = keep(
        rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "mixing-leaves"
    )
    total = share * (sums.agg(F.sum("tokens")).first()[0] or 0)
    supply = sums.select(*LEVELS, (F.col("tokens") * max_epochs).alias("supply"))
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(1)).cast("int")
    budgets = leaf_budgets(supply, weights, total).join(sums, list(LEVELS)).withColumn("epochs", whole)
    budgets = budgets.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")).withColumn("leaf", _leaf())
    budgets = keep(budgets, "mixing-budgets")

    open_ = keep(
        left_join_by_key(keep(rows.select("id", "tokens", _leaf().alias("leaf")), "mixing-rows"),
                         budgets.filter("rest > 0").select("leaf", "epochs", "rest", "n"), "leaf", "n")
        .filter(F.col("rest").isNotNull())
        .withColumn("__hash", _order(F.col("epochs"), seed))
        .select("leaf", "id", "tokens", "rest", "__hash", _bucket().alias("bucket")),
        "mixing-open",
    )
    by_bucket = open_.groupBy("leaf", "bucket").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    along = Window.partitionBy("leaf").orderBy("bucket")  # at most 2**BUCKET_BITS rows a leaf
    edge = (
        by_bucket.withColumn("upto", F.sum("tokens").over(along))
        .filter(F.col("upto") > F.col("rest"))
        .groupBy("leaf")
        .agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("base")), F.col("bucket")).alias("edge"))
        .select("leaf", "edge.bucket", "edge.base")
    )
    inside = Window.partitionBy("leaf").orderBy("__hash", "id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        open_.join(edge, ["leaf", "bucket"])
        .withColumn("upto", F.col("base") + F.sum("tokens").over(inside))
        .filter(F.col("upto") <= F.col("rest"))
        .groupBy("leaf")
        .agg(F.max(F.struct("__hash", "id")).alias("last"))
    )
    return (
        budgets.join(edge.select("leaf", "bucket"), "leaf", "left")
        .join(last, "leaf", "left")
        .select("leaf", *LEVELS, "n", "tokens", "supply", "budget", "epochs", "rest", "bucket",
                F.col("last.__hash").alias("last_hash"), F.col("last.id").alias("last_id"))
    )


def _prepared(docs: DataFrame, domain: Column, id_col: str, tokens: Column) -> list[Column]:
    level = {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}
    return [
        F.col(id_col).alias("id"),
        *[F.coalesce(level[c].cast("string"), F.lit("")).alias(c) for c in LEVELS],
        F.coalesce(tokens, F.lit(0)).alias("tokens"),
    ]


def _in_prefix(seed: int) -> Column:
    """Whether a row, joined with its leaf's plan, is in the partial epoch."""
    hash_ = _order(F.col("epochs"), seed)
    bucket = F.shiftrightunsigned(hash_, 64 - BUCKET_BITS)
    tie = (hash_ == F.col("last_hash")) & (F.coalesce(F.col("id") <= F.col("last_id"), F.col("id").isNull()))
    at_edge = (bucket == F.col("bucket")) & F.col("last_hash").isNotNull() & ((hash_ < F.col("last_hash")) | tie)
    return F.coalesce((F.col("rest") > 0) & (F.col("bucket").isNull() | (bucket < F.col("bucket")) | at_edge), F.lit(False))


def mix(
    docs: DataFrame,
    domain: Column,
    weights: dict[tuple[str, ...], float],
    share: float,
    max_epochs: int = 1,
    id_col: str = "doc_id",
    tokens: Column | None = None,
    seed: int = SEED,
) -> DataFrame:
    """(id, domain, lang, source, tokens, epoch): each document once for each epoch that takes it.

    ``share`` of the tokens of ``docs`` is the root's budget. Tokens are words unless ``tokens`` is given.
    Null domains, languages and sources count as "". Documents without tokens are taken with whole epochs
    and with the prefix they fall in; a leaf without any token is taken once. Rows with the same id are
    taken or left together; null ids come first in the order, together. Same seed, same selection. An
    empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    rows = keep(docs.select(*_prepared(docs, domain, id_col, words() if tokens is None else tokens)), "mixing-docs")
    leaves = keep(plan(rows, weights, share, max_epochs, seed), "mixing-plan")
    settings = leaves.select("leaf", "n", "epochs", "rest", "bucket", "last_hash", "last_id")
    placed = left_join_by_key(keep(rows.withColumn("leaf", _leaf()), "mixing-keyed"), settings, "leaf", "n")
    times = F.col("epochs") + _in_prefix(seed).cast("int")
    taken = placed.withColumn("__times", times).filter("__times > 0")
    return taken.select(
        F.col("id").alias(id_col), *LEVELS, "tokens", F.explode(F.sequence(F.lit(0), F.col("__times") - 1)).alias("epoch")
    )


def chosen(
    docs: DataFrame, domain: Column, weights: dict[tuple[str, ...], float], share: float, id_col: str = "doc_id", seed: int = SEED
) -> DataFrame:
    """The rows of ``docs`` that one epoch at most takes, with all their columns, each once."""
    rows = keep(docs.select(*_prepared(docs, domain, id_col, words())), "mixing-docs")
    leaves = keep(plan(rows, weights, share, 1, seed), "mixing-plan")
    settings = leaves.select("leaf", "n", "epochs", "rest", "bucket", "last_hash", "last_id")
    tagged = docs.select(
        F.struct(*docs.columns).alias("row"), *_prepared(docs, domain, id_col, F.lit(0))
    ).withColumn("leaf", _leaf())
    placed = left_join_by_key(tagged.select("row", "id", "leaf"), settings, "leaf", "n")
    return placed.filter((F.col("epochs") > 0) | _in_prefix(seed)).select("row.*")
