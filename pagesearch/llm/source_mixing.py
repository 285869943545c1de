"""Mixing sources to target weights by hierarchical budgets, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Work, broadcast_if_small, materialize, unused

LEVELS = ("domain", "lang", "source")
#: Weights of siblings; a name that is not listed weighs 1.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}}
#: Budget in per cent of all tokens, most passes over a leaf, and seed of the orders.
PERCENT, MAX_EPOCHS, SEED = 60, 2, 17
#: Hex digits of the order key that one step of the search for a leaf's cut reads, and steps, so that no task orders
#: more than 16 ** DIGITS sums or what shares DIGITS * STEPS digits; leaves that are broadcast.
DIGITS, STEPS, BROADCAST_LEAVES = 2, 4, 100_000


def tokens(text: Column) -> Column:
    """Estimated tokens: one for each started four bytes."""
    return ((F.octet_length(text) + 3) / 4).cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source: its last digit mod 4, 0 without one."""
    return F.concat(F.lit("d"), (F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(source, "([0-9])[^0-9]*$", 1), F.lit("")), F.lit("9")).cast("int"), F.lit(0)) % 4).cast("string"))


def with_leaf(docs: DataFrame) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens; a null language or source is the empty name."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    length = F.coalesce(tokens(F.col("text").cast("string")), F.lit(0).cast("long"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), domain_of(name("source")).alias("domain"), name("lang").alias("lang"), name("source").alias("source"), length.alias("n_tokens"))


def _weight(level: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def share(nodes: DataFrame, parent: tuple[str, ...], level: str, weights: dict[str, int]) -> DataFrame:
    """Budgets of siblings: ``nodes`` has parent names, the level's name, cap and the parent's ``given``.

    Siblings get their part by weight, but no more than cap; what a sibling leaves goes to the others by weight. In
    order of cap / weight the siblings that are filled come first: one is filled while its cap is within its weight's
    part of what those before it leave. All sums are of integers; a part is rounded down.
    """
    big = lambda c: F.col(c).cast("decimal(20,0)")
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), level)
    whole = Window.partitionBy(*parent)
    out = nodes.withColumn("w", _weight(level, weights)).filter("w > 0")
    out = out.withColumn("cap_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    out = out.withColumn("w_from", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    out = out.withColumn("left", F.col("given") - F.col("cap_before"))
    out = out.withColumn("filled", (F.col("left") >= 0) & (big("cap") * big("w_from") <= big("w") * big("left")))
    open_left = F.max(F.when(~F.col("filled"), F.col("left"))).over(whole)
    open_w = F.max(F.when(~F.col("filled"), F.col("w_from"))).over(whole)
    out = out.withColumn("open_left", open_left).withColumn("open_w", open_w)
    part = F.expr("cast(w as decimal(18,0)) * cast(open_left as decimal(19,0)) div open_w")
    return out.withColumn("budget", F.when(F.col("filled"), F.col("cap")).otherwise(part).cast("long")).select(*parent, level, "budget")


def leaf_budgets(leaves: DataFrame, total: int, weights: dict[str, dict[str, int]], max_epochs: int) -> DataFrame:
    """Leaves with ``budget``. A shortage goes to siblings first: a node's cap is what its leaves can give, so only what
    a whole subtree cannot use is left to the siblings of its ancestors."""
    leaves = leaves.withColumn("cap", F.col("supply") * max_epochs)
    given = None
    for depth, level in enumerate(LEVELS):
        parent = LEVELS[:depth]
        nodes = leaves.groupBy(*parent, level).agg(F.sum("cap").alias("cap"))
        nodes = nodes.withColumn("given", F.lit(total).cast("long")) if given is None else nodes.join(given.withColumnRenamed("budget", "given"), list(parent))
        given = share(nodes, parent, level, weights.get(level, {}))
    return leaves.drop("cap").join(given, list(LEVELS), "left").withColumn("budget", F.coalesce("budget", F.lit(0).cast("long")))


def order_key(epoch: Column, seed: int) -> Column:
    """A document's place in the seeded order of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def cuts(docs: DataFrame, weights: dict[str, dict[str, int]], percent: int, max_epochs: int, seed: int) -> DataFrame:
    """Leaves with ``full``, the whole epochs that all their documents are in, and ``cut``, the last order key that the
    part of the next epoch takes (null: none)."""
    with Work(docs.sparkSession) as work:
        return _cuts(work, docs, weights, percent, max_epochs, seed)


def _cuts(work: Work, docs: DataFrame, weights: dict[str, dict[str, int]], percent: int, max_epochs: int, seed: int) -> DataFrame:
    slim = work.table(with_leaf(docs))
    leaves = work.table(slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply")))
    total = (leaves.agg(F.sum("supply")).first()[0] or 0) * percent // 100
    leaves = work.table(leaf_budgets(leaves, total, weights, max_epochs))
    leaves = leaves.withColumn("full", F.when(F.col("supply") > 0, F.expr("budget div supply")).otherwise(F.lit(0)).cast("int"))
    leaves = leaves.withColumn("rest", F.col("budget") - F.col("full") * F.col("supply"))
    edge = work.table(leaves.filter("rest > 0").select(*LEVELS, "full", "rest", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before")))

    def near(edge: DataFrame) -> DataFrame:
        """Documents of the leaves whose order keys begin with the prefix."""
        rows = slim.join(broadcast_if_small(edge, BROADCAST_LEAVES), list(LEVELS))
        rows = rows.select(*LEVELS, "full", "rest", "prefix", "before", "n_tokens", order_key(F.col("full") + 1, seed).alias("u"))
        return rows.filter(F.col("u").startswith(F.col("prefix")))

    def upto(order: str) -> Column:
        """Tokens of all that comes before, in the leaf's order."""
        return F.col("before") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")

    for step in range(1, STEPS + 1):  # each step finds, in the prefix so far, the longer prefix that the cut lies in
        sums = near(edge).groupBy(*LEVELS, "full", "rest", "before", F.substring("u", 1, step * DIGITS).alias("prefix")).agg(F.sum("n_tokens").alias("n"))
        reached = sums.withColumn("upto", upto("prefix")).filter("upto < rest and upto + n >= rest and n > 0")
        edge = work.table(reached.select(*LEVELS, "full", "rest", "prefix", F.col("upto").alias("before")))
    last = near(edge).groupBy(*LEVELS, "rest", "before", "u").agg(F.sum("n_tokens").alias("n"))
    cut = last.withColumn("upto", upto("u")).filter("upto < rest").groupBy(*LEVELS).agg(F.max("u").alias("cut"))
    return materialize(leaves.join(cut, list(LEVELS), "left").filter("budget > 0").select(*LEVELS, "full", "cut"))


def _times(seed: int) -> Column:
    taken = F.coalesce(order_key(F.col("full") + 1, seed) <= F.col("cut"), F.lit(False))
    return (F.col("full") + taken.cast("int")).cast("int")


def source_mixing(docs: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, percent: int = PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and times, the number of epochs that a document is taken in, if any.

    A leaf's budget is spent on whole epochs, then on the prefix of the next epoch's seeded order: a document is taken
    while those before it leave budget, so a leaf exceeds its budget by less than one document. Null languages and
    sources are the empty name; null texts and empty texts have no tokens and are taken only in whole epochs. Rows that
    repeat a doc_id are taken together. An empty table gives an empty result; other columns are ignored.
    """
    leaves = broadcast_if_small(cuts(docs, weights, percent, max_epochs, seed), BROADCAST_LEAVES)
    return with_leaf(docs).join(leaves, list(LEVELS)).withColumn("times", _times(seed)).filter("times > 0").select("doc_id", *LEVELS, "n_tokens", "times")


def mixed(docs: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, percent: int = PERCENT, max_epochs: int = 1, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as source_mixing() takes them.

    Null languages and sources are the empty name, null and empty texts have no tokens, and rows that repeat a doc_id
    are taken together, as there. An empty table stays empty.
    """
    own = unused(docs, "__leaf")
    leaves = cuts(docs, weights, percent, max_epochs, seed).select(F.struct("*").alias(own))
    leaf = F.col(own)
    name = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    at_leaf = (domain_of(name("source")) == leaf["domain"]) & (name("lang") == leaf["lang"]) & (name("source") == leaf["source"])
    joined = docs.join(broadcast_if_small(leaves, BROADCAST_LEAVES), at_leaf)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), (leaf["full"] + 1).cast("string"), F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit(""))).cast("binary"))
    times = (leaf["full"] + F.coalesce(key <= leaf["cut"], F.lit(False)).cast("int")).cast("int")
    out = joined.filter(times > 0)
    if max_epochs > 1:
        out = out.withColumn(unused(out, "__copy"), F.explode(F.array_repeat(F.lit(0), times)))
    return out.select(*(docs[c] for c in docs.columns))


def _case(level: str, weights: dict[str, int]) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{n}' THEN {w}" for n, w in weights.items()) + " ELSE 1 END" if weights else "1"


def _level_sql(depth: int, weights: dict[str, dict[str, int]]) -> str:
    level, parent = LEVELS[depth], ", ".join(LEVELS[:depth])
    part = f"PARTITION BY {parent}" if parent else ""
    keys = ", ".join(LEVELS[: depth + 1])
    given = f"JOIN (SELECT {parent}, budget AS given FROM b{depth - 1}) USING ({parent})" if depth else "CROSS JOIN total"
    return f"""
n{depth} AS (SELECT *, given - cap_before AS lft, given >= cap_before AND cap * w_from <= w * (given - cap_before) AS filled FROM (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from
  FROM (SELECT {keys}, cap, given, ({_case(level, weights.get(level, {}))})::HUGEINT AS w FROM (SELECT {keys}, sum(cap)::HUGEINT AS cap FROM leaves GROUP BY {keys}) {given})
  WINDOW o AS ({part} ORDER BY cap / w, {level}))),
b{depth} AS (SELECT {keys}, CASE WHEN filled THEN cap ELSE w * (max(CASE WHEN NOT filled THEN lft END) OVER ({part})) // (max(CASE WHEN NOT filled THEN w_from END) OVER ({part})) END AS budget FROM n{depth})"""


def sql(weights: dict[str, dict[str, int]] = WEIGHTS, percent: int = PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    return f"""
WITH d AS (SELECT doc_id, 'd' || (coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9])[^0-9]*$', 1), '') AS INT), 0) % 4) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce((strlen(text) + 3) // 4, 0) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS supply, sum(n_tokens)::HUGEINT * {max_epochs} AS cap FROM d GROUP BY ALL),
total AS (SELECT coalesce(sum(supply), 0)::HUGEINT * {percent} // 100 AS given FROM leaves),
{",".join(_level_sql(k, weights) for k in range(3))},
l AS (SELECT domain, lang, source, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS f, budget - CASE WHEN supply > 0 THEN budget // supply ELSE 0 END * supply AS rest FROM leaves JOIN b2 USING (domain, lang, source) WHERE budget > 0),
k AS (SELECT *, md5(concat_ws(':', '{seed}', (f + 1)::VARCHAR, coalesce(doc_id::VARCHAR, ''))) AS u FROM d JOIN l USING (domain, lang, source)),
t AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY u RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(n_tokens) OVER (PARTITION BY domain, lang, source, u) AS so_far FROM k)
SELECT doc_id, domain, lang, source, n_tokens, (f + CASE WHEN so_far < rest THEN 1 ELSE 0 END)::INT AS times FROM t WHERE f > 0 OR so_far < rest
"""
