"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

The tree is domain - language - source. Tokens are budgeted from the root down:
a node's budget goes to its children by weight, but none gets more than it can
supply (its tokens times the allowed epochs); what a child can't take goes to
its siblings, and since a node is never budgeted more than all its leaves can
supply, a shortage reaches other branches only when the siblings are exhausted.
Every leaf then takes whole epochs and a prefix of one more epoch, each in its
own seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD

LEVELS = ("domain", "lang", "source")
#: What rows without a language or source are filed under.
MISSING = "(none)"
#: Share of the corpus's tokens to take, passes over a leaf at most, and rows of a leaf that one part of its order holds about.
BUDGET, EPOCHS, PART_ROWS = 0.6, 2, 500
#: Parts of a leaf's order that are summed up together, and leaves whose plan is broadcast.
SHELF, LEAVES = 1_000, 100_000


def word_count(col: Column) -> Column:
    """Words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def default_domain(source: str = "source") -> Column:
    """One of four domains, by a checksum of the source's name."""
    digit = F.conv(F.substring(F.md5(F.coalesce(F.col(source).cast("string"), F.lit(MISSING)).cast("binary")), 1, 1), 16, 10)
    return F.concat(F.lit("domain"), (digit.cast("int") % 4).cast("string"))


def leaves(docs: DataFrame, *more: Column, domain: Column | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, domain, lang, source and tokens of each row, and the columns `more`, which mix() hands on."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c)
    return docs.select(F.col(id_col).alias("doc_id"), (default_domain() if domain is None else domain).alias("domain"), name("lang"), name("source"), word_count(F.col(text_col)).alias("tokens"), *more)


def _weight(names: str, weights: dict[str, float] | None) -> Column:
    """A node's target weight among its siblings: the given one, 0 if others are given, equal weights if none are."""
    if weights is None:
        return F.lit(1.0)
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])[F.col(names)], F.lit(0.0))


def _shared(children: DataFrame, parent: list[str], own: str) -> DataFrame:
    """children (cap, w, budget of the parent) with `grant`, their part of it: by weight, at most cap, the rest among siblings.

    In ascending order of cap / w a child is full exactly if its ratio is at
    most what is left for each unit of weight from it on, so full ones are a
    prefix, and one pass over running sums settles all of them.
    """
    ratio = F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(0.0))
    cap = F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0))
    rows = children.withColumn("cap", cap).withColumn("ratio", ratio)
    order = Window.partitionBy(*parent).orderBy("ratio", own)
    whole = Window.partitionBy(*parent)
    rows = rows.withColumn("before", F.sum("cap").over(order) - F.col("cap")).withColumn("after", F.sum("w").over(whole) - F.sum("w").over(order) + F.col("w"))
    rows = rows.withColumn("full", F.col("ratio") * F.col("after") <= F.col("budget") - F.col("before"))
    left = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(F.lit(0))).over(whole)
    unit = F.try_divide(left, F.sum(F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("w"))).over(whole))
    return rows.withColumn("grant", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * unit))


def budgets(rows: DataFrame, budget: float = BUDGET, epochs: int = EPOCHS, weights: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """domain, lang, source, rows, supply and budget (tokens, whole) of each leaf.

    weights maps a level's name to {node: weight}, the same under every parent;
    nodes that it leaves out get nothing, levels that it leaves out weigh their
    nodes equally. budget is a share of all tokens. Leaves without tokens get 0.
    """
    weights = weights or {}
    leaf = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply"), F.count("*").alias("rows"))
    leaf = leaf.withColumn("cap", F.when(_weight("source", weights.get("source")) > 0, F.col("supply") * epochs).otherwise(F.lit(0)))
    total = leaf.agg((F.sum("supply") * F.lit(budget)).alias("budget"))
    tree = {3: leaf}
    for depth in (2, 1):
        level = LEVELS[depth - 1]
        caps = tree[depth + 1].groupBy(*LEVELS[:depth]).agg(F.sum("cap").alias("cap"))
        tree[depth] = caps.withColumn("cap", F.when(_weight(level, weights.get(level)) > 0, F.col("cap")).otherwise(F.lit(0)))
    parent = total
    for depth in (1, 2, 3):
        level, above = LEVELS[depth - 1], list(LEVELS[: depth - 1])
        children = tree[depth].join(parent, above) if above else tree[depth].crossJoin(F.broadcast(parent))  # one row
        shared = _shared(children.withColumn("w", _weight(level, weights.get(level))), above or [F.lit(0)], level)
        parent = shared.select(*LEVELS[:depth], F.col("grant").alias("budget"), *(["rows", "supply"] if depth == 3 else []))
    return parent.select(*LEVELS, "rows", "supply", F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


def mix(rows: DataFrame, plan: DataFrame, epochs: int = EPOCHS, seed: int = 0, part_rows: int = PART_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """doc_id, domain, lang, source, tokens, epoch and start for every selection of a row.

    rows comes from leaves(), plan from budgets(). A leaf takes its rows whole in
    every epoch its budget covers; in the last, a prefix of what is left of the
    budget, in the order of md5(seed:epoch:doc_id). start is the number of the
    leaf's tokens before the row in that order; tokens are those that are taken:
    of the row that crosses the end of the budget, its first ones, so that every
    leaf gets its whole budget. Rows without words are never taken. Rows that
    repeat an id are selected each; where their order is tied, the longer one
    comes last. Further columns of rows follow. Where rows carry texts, `counted`
    may give the same rows without, for the sums.
    """
    key = list(LEVELS)
    more = [c for c in rows.columns if c not in ("doc_id", *key, "tokens")]
    usable = plan.filter("supply > 0").withColumn("parts", F.ceil(F.col("rows") / part_rows))
    full = F.floor(F.col("budget") / F.col("supply"))
    last = F.least(F.lit(epochs - 1), full)
    # One row for each leaf: while they are few, rows and what they carry aren't dealt by leaf.
    usable = usable.drop("rows")
    few = usable.limit(LEAVES + 1).count() <= LEAVES

    def dealt(some: DataFrame) -> DataFrame:
        """The rows of every epoch. A leaf's order is cut into parts of about part_rows rows, and these into shelves, so no leaf is ever one task."""
        drawn = some.filter("tokens > 0").join(F.broadcast(usable) if few else usable, key).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        drawn = drawn.withColumn("order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("doc_id").cast("string")).cast("binary")))
        drawn = drawn.withColumn("left", F.least("supply", F.col("budget") - F.col("epoch") * F.col("supply")))
        share = F.conv(F.substring("order", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
        return drawn.withColumn("part", F.floor(share * F.col("parts")))

    drawn = dealt(rows)
    sums = dealt(rows if counted is None else counted).groupBy(*key, "epoch", "part").agg(F.sum("tokens").alias("sum")).withColumn("shelf", F.floor(F.col("part") / SHELF))
    shelves = sums.groupBy(*key, "epoch", "shelf").agg(F.sum("sum").alias("all"))
    upto = lambda order, *by: Window.partitionBy(*key, "epoch", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    shelves = shelves.select(*key, "epoch", "shelf", (F.sum("all").over(upto("shelf")) - F.col("all")).alias("below"))
    ahead = sums.withColumn("beside", F.sum("sum").over(upto("part", "shelf")) - F.col("sum")).join(shelves, [*key, "epoch", "shelf"])
    ahead = ahead.select(*key, "epoch", "part", (F.col("below") + F.col("beside")).alias("ahead"))
    within = Window.partitionBy(*key, "epoch", "part").orderBy("order", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = drawn.join(ahead, [*key, "epoch", "part"]).withColumn("start", F.col("ahead") + F.sum("tokens").over(within) - F.col("tokens"))
    placed = placed.filter(F.col("start") < F.col("left")).withColumn("tokens", F.least("tokens", F.col("left") - F.col("start")).cast("long"))
    return placed.select("doc_id", *key, "tokens", "epoch", "start", *more)


def achieved(plan: DataFrame, drawn: DataFrame) -> DataFrame:
    """domain, lang, source, supply, budget and taken (tokens that mix() selected) of every leaf of the plan."""
    taken = drawn.groupBy(*LEVELS).agg(F.sum("tokens").alias("taken"))
    return plan.join(taken, list(LEVELS), "left").select(*LEVELS, "supply", "budget", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
