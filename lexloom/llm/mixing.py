"""Mixing sources to target weights by hierarchical budgeting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexloom.llm.store import Workspace, carried, table

#: Levels of the tree, from the root down.
LEVELS = ("domain", "lang", "source")
#: Weights by path; a path that is not named weighs 1, one of weight 0 is left out.
WEIGHTS: dict[tuple[str, ...], int] = {
    ("web",): 2, ("books",): 3, ("news",): 1, ("forum",): 1,
    ("web", "en"): 4, ("web", "de"): 2, ("books", "en"): 2, ("news", "fr"): 2,
    ("books", "en", "src5"): 3,
}
BUDGET_SHARE = (3, 4)  # of all tokens: the budget of the registered query
MAX_EPOCHS = 4
SEED = 17
_BUCKET_DIGITS = 3  # a leaf's order is cut into 16 ** 3 ranges of its hash
_WIDE = "decimal(38,0)"


def domain_of(source: Column) -> Column:
    """A source's domain, by the number at the end of its name."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return (F.when(number == "", "forum").when(number.cast("int") < 5, "web")
            .when(number.cast("int") < 10, "books").when(number.cast("int") < 15, "news")
            .otherwise("forum"))


def word_count(text: Column) -> Column:
    """Words between ASCII white space; none in a null or empty text."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")),
                          F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _marked(docs: DataFrame, levels: Mapping[str, Column], tokens: Column) -> DataFrame:
    """Carried rows with their place in the tree, tokens and a key for the seeded orders."""
    if "text" not in docs.columns or "doc_id" not in docs.columns:
        raise ValueError("documents have doc_id and text")
    content = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.select(*carried(docs)[0], *(
        F.coalesce(c.cast("string"), F.lit("")).alias(f"_l{i}") for i, c in enumerate(levels.values())),
        tokens.alias("_tokens"),
        F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), content).alias("_key"))


def _weight(path: Sequence[str], weights: Mapping[tuple[str, ...], int]) -> Column:
    named = {k: v for k, v in weights.items() if len(k) == len(path)}
    found = F.lit(1)
    for names, weight in named.items():
        here = F.lit(True)
        for column, name in zip(path, names):
            here = here & (F.col(column) == name)
        found = F.when(here, F.lit(int(weight))).otherwise(found)
    return found.cast(_WIDE)


def _share(nodes: DataFrame, path: Sequence[str], weights) -> DataFrame:
    """Split each parent's ``_budget`` over its children; adds ``_given``.

    Children take in proportion to their weights, but none more than its ``_room``. Whoever is
    full leaves the rest to its siblings: in the order of room by weight, the full ones
    come first, so prefix sums tell how many are full and what is left for the others. The
    remaining shares are rounded so that their sum is exact.
    """
    nodes = nodes.withColumn("_w", F.when(F.col("_room") > 0, _weight(path, weights)).otherwise(
        F.lit(0).cast(_WIDE))).where("_w > 0")
    siblings = Window.partitionBy(*path[:-1]) if len(path) > 1 else Window.partitionBy(F.lit(0))
    order = siblings.orderBy(F.col("_room").cast("double") / F.col("_w").cast("double"), path[-1])
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    ahead = F.coalesce(F.sum("_room").over(order.rowsBetween(Window.unboundedPreceding, -1)),
                       F.lit(0)).cast(_WIDE)
    behind = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)).cast(_WIDE)
    wide = nodes.select("*", ahead.alias("_ahead"), behind.alias("_behind"))
    wide = wide.withColumn("_full", F.expr(
        "cast(_room * _behind as decimal(38,0)) + cast(_ahead * _w as decimal(38,0))"
        " <= cast(_budget * _w as decimal(38,0))"))
    wide = (wide.withColumn("_rest", (F.col("_budget") - F.coalesce(F.sum(
                F.when(F.col("_full"), F.col("_room"))).over(siblings), F.lit(0))).cast(_WIDE))
            .withColumn("_open", F.when(~F.col("_full"), F.col("_w")).otherwise(0).cast(_WIDE)))
    wide = (wide.withColumn("_all", F.sum("_open").over(siblings).cast(_WIDE))
            .withColumn("_upto", F.sum("_open").over(upto).cast(_WIDE)))
    given = F.expr("case when _full then cast(_room as bigint) else"
                   " cast(_rest * _upto as decimal(38,0)) div _all"
                   " - cast(_rest * (_upto - _open) as decimal(38,0)) div _all end")
    return wide.withColumn("_given", given.cast(_WIDE)).drop(
        "_w", "_ahead", "_behind", "_full", "_rest", "_open", "_all", "_upto")


def leaf_budgets(leaves: DataFrame, path: Sequence[str], budget: int,
                 weights: Mapping[tuple[str, ...], int], max_epochs: int) -> DataFrame:
    """Tokens of each leaf: ``path, _total, _given``.

    ``leaves`` holds ``path`` and ``_total`` tokens; a leaf can give that ``max_epochs`` times.
    A node can give what its children can, so going down from the root what one child is
    short of first goes to its siblings, and only what all of them are short of has already
    gone to the siblings of an ancestor.
    """
    room = leaves.select(*path, "_total", F.when(_weight(path, weights) > 0, F.col("_total") * max_epochs)
                         .otherwise(0).cast(_WIDE).alias("_room"))
    levels = [room]
    for depth in range(len(path) - 1, 0, -1):
        own = path[:depth]
        up = levels[0].groupBy(*own).agg(F.sum("_room").cast(_WIDE).alias("_room"))
        levels.insert(0, up.withColumn("_room", F.when(_weight(own, weights) > 0, F.col("_room"))
                                       .otherwise(0).cast(_WIDE)))
    everything = levels[0].agg(F.sum("_room")).first()[0] or 0
    top = F.lit(str(max(0, min(budget, int(everything))))).cast(_WIDE)
    given = _share(levels[0].withColumn("_budget", top), path[:1], weights)
    for depth in range(2, len(path) + 1):
        parents = given.select(*path[:depth - 1], F.col("_given").alias("_budget"))
        given = _share(levels[depth - 1].join(parents, list(path[:depth - 1])), path[:depth], weights)
    return given.select(*path, "_total", "_given")


def _order(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.col("_key")))


def mix_sources(docs: DataFrame, levels: Mapping[str, Column], budget: int | tuple[int, int],
                weights: Mapping[tuple[str, ...], int] | None = None, tokens: Column | None = None,
                max_epochs: int = MAX_EPOCHS, seed: int = SEED, work: Workspace | None = None) -> DataFrame:
    """``docs`` repeated and cut to the mix: all columns, ``epoch`` and ``tokens_taken``.

    ``levels`` names the tree's levels, root first, and the columns they come from. ``weights``
    are whole numbers by path. ``budget`` is in tokens, or a share of all tokens as two numbers, and
    is met exactly, unless all sources together, each ``max_epochs`` times, hold less.

    A leaf first gives whole epochs and then the beginning of one more, in an order made from
    ``seed``, the epoch, id and text. Only the last document may be taken in part
    (``tokens_taken`` below its tokens: the prefix to use). To find the place where a leaf's
    tokens end, they are summed by ranges of the order's hash, and only the rows of the one range
    where the budget ends are sorted, so a leaf with most of the rows stays spread out.

    A null level is the empty name. Null and empty texts have no tokens and come along with each
    whole epoch. Repeated rows are taken one by one. Zero or negative budgets and empty tables
    give an empty result. Columns named ``epoch`` or ``tokens_taken`` are replaced, all others go along.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "mixing")
    weights = WEIGHTS if weights is None else weights
    docs = docs.drop("epoch", "tokens_taken")
    _, given = carried(docs)
    path = [f"_l{i}" for i in range(len(levels))]
    rows = _marked(docs, levels, word_count(F.col("text")) if tokens is None else tokens.cast("long"))
    slim = work.keep(rows.select(*path, "_tokens", "_key"), "tokens")
    leaves = work.keep(slim.groupBy(*path).agg(F.sum("_tokens").alias("_total")), "leaves")
    if isinstance(budget, tuple):
        part, whole = budget
        total = leaves.agg(F.coalesce(F.sum("_total"), F.lit(0)).alias("t")).first().t
        budget = total * part // whole
    budgets = work.keep(
        leaf_budgets(leaves, path, budget, weights, max_epochs)
        .where("_given > 0")
        .select(*path, F.expr("_given div _total").alias("_whole"),
                F.expr("cast(_given - cast((_given div _total) * cast(_total as decimal(38,0))"
                       " as decimal(38,0)) as bigint)").alias("_rest")), "budgets")
    bucket = F.substring("_order", 1, _BUCKET_DIGITS)
    ranges = (slim.join(budgets, path).where("_rest > 0")
              .withColumn("_order", _order(F.col("_whole"), seed))
              .groupBy(*path, "_rest", bucket.alias("_bucket")).agg(F.sum("_tokens").alias("_sum")))
    before = Window.partitionBy(*path).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = work.keep(
        ranges.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .where("_start < _rest and _rest <= _start + _sum")
        .select(*path, F.col("_bucket").alias("_end"), "_start"), "ends")
    plan = work.keep(budgets.join(ends, path, "left"), "plan")
    # One row for each leaf; Spark broadcasts it where it measures it small.
    planned = rows.join(plan, path).withColumn("_order", _order(F.col("_whole"), seed))
    epochs = planned.where("_whole > 0").select(
        *given, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_whole") - 1)).alias("epoch"),
        F.col("_tokens").alias("tokens_taken"))
    full = planned.where((bucket < F.col("_end")) & (F.col("_tokens") > 0)).select(
        *given, F.col("_whole").alias("epoch"), F.col("_tokens").alias("tokens_taken"))
    in_order = Window.partitionBy(*path).orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    last = (planned.where((bucket == F.col("_end")) & (F.col("_tokens") > 0))
            .withColumn("_before", F.col("_start") + F.coalesce(F.sum("_tokens").over(in_order), F.lit(0)))
            .where("_before < _rest")
            .select(*given, F.col("_whole").alias("epoch"),
                    F.least("_tokens", F.col("_rest") - F.col("_before")).alias("tokens_taken")))
    return epochs.unionByName(full).unionByName(last)


def document_levels() -> dict[str, Column]:
    """The tree of the ``documents`` table."""
    return {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to three quarters of their tokens."""
    docs = table(spark, sf_dir, "documents")
    return mix_sources(docs, document_levels(), BUDGET_SHARE).select(
        "doc_id", "lang", "source", "epoch", "tokens_taken")
