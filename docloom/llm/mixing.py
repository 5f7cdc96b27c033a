"""Mixing sources to target weights: hierarchical budgeting.

Weights flow down a tree (domain, language, source).  Each node splits its
tokens among its children by weight; a child that cannot use its share is full,
and what it leaves goes to its siblings.  As a node's own capacity is that of
its whole subtree, a shortage reaches an ancestor's siblings only when no
sibling below can take it.  The split has a closed form: by capacity per weight
ascending, a child is full when the children before it and itself at their
level fit into the amount.  Each leaf then takes its tokens from seeded epochs:
whole epochs first, then the prefix of the next epoch's seeded order.

Only per-leaf sums meet in a window; inside a leaf, running sums are built from
buckets of the seeded order, so that no task holds a leaf whole.

Defined cases: null or empty texts have no tokens and are never taken; null
level values form a leaf of their own; equal rows share a place in the order and
are taken together or not at all; weights that are missing, null or not positive
count as ``default_weight``; an empty table gives an empty result; extra
columns are kept unless they carry a name of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import cut, with_small

BUCKET_HEX = 3  # 4096 buckets in a leaf's order
LEAVES = 200_000  # leaf rows held by every task at most; a shuffle join beyond


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def split_budget(nodes: DataFrame, parent: list[str], amount: str) -> DataFrame:
    """Adds ``alloc`` to ``nodes`` (parent columns, weight, cap, amount of the parent)."""
    ratio = F.col("cap") / F.col("weight")
    w = Window.partitionBy(*[F.col(p) for p in parent]) if parent else Window.partitionBy(F.lit(0))
    order = w.orderBy("_ratio", "_node")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    n = nodes.withColumn("_ratio", ratio).withColumn("_before", before).withColumn("_rest", rest)
    n = n.withColumn("_full", F.col("_before") + F.col("_ratio") * F.col("_rest") <= F.col(amount))
    used = F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(w), F.lit(0))
    open_w = F.coalesce(F.sum(F.when(~F.col("_full"), F.col("weight"))).over(w), F.lit(0.0))
    n = n.withColumn("_used", used).withColumn("_open", open_w)
    alloc = F.when(F.col("_full"), F.col("cap").cast("double")).otherwise((F.col(amount) - F.col("_used")) * F.col("weight") / F.col("_open"))
    return n.withColumn("alloc", alloc).drop("_ratio", "_before", "_rest", "_full", "_used", "_open")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], total: Column, max_epochs: int, default_weight: float) -> DataFrame:
    """(levels, tokens, alloc) of leaf rows (levels, tokens); ``total`` is a
    column over the leaf table's sum ``all_tokens``."""
    leaf = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    tot = leaf.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    top = tot.select(total.cast("double").alias("alloc"))
    up = leaf.crossJoin(F.broadcast(top))  # one row
    for k, level in enumerate(levels):
        path = levels[: k + 1]
        table = weights.get(level, {})
        pairs = [F.lit(x) for kv in table.items() for x in (kv[0], float(kv[1]))]
        weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col(level)), F.lit(default_weight)) if pairs else F.lit(default_weight)
        weight = F.when(weight > 0, weight).otherwise(default_weight)
        node = up.groupBy(*path).agg(F.sum("cap").alias("cap"), F.max("alloc").alias("amount"))
        node = node.withColumn("weight", weight).withColumn("_node", F.col(level))
        node = split_budget(node, levels[:k], "amount").select(*path, F.col("alloc"))
        on = None
        a, b = up.drop("alloc").alias("a"), node.alias("b")
        for c in path:
            e = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
            on = e if on is None else on & e
        up = a.join(b, on).select("a.*", "b.alloc")
    return up.select(*levels, "tokens", F.floor(F.least(F.col("alloc"), F.col("cap")) + 1e-6).cast("bigint").alias("alloc"))


def leaf_key(names: list[str]) -> Column:
    return F.md5(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))


def place(seed: int, epoch: Column, doc_id: Column, text: Column) -> Column:
    """Place in a leaf's seeded order of one epoch; equal rows share a place."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.concat(key, F.md5(F.coalesce(text, F.lit(""))))


def leaf_plan(rows: DataFrame, names: list[str], weights: dict[str, dict[str, float]], total: Column, max_epochs: int, default_weight: float, seed: int) -> DataFrame:
    """(leaf, full, cutoff): whole epochs of each leaf and the last place taken
    in the next one, from rows (names, leaf, _id, _text, n_tokens)."""
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    plan = budgets(leaves, names, weights, total, max_epochs, default_weight)
    plan = cut(plan.select(leaf_key(names).alias("leaf"), F.floor(F.col("alloc") / F.col("tokens")).cast("int").alias("full"),
                           (F.col("alloc") % F.col("tokens")).alias("rest")))
    part = with_small(rows, plan.filter("rest > 0"), ["leaf"], "inner", LEAVES)
    part = part.select("leaf", "rest", "n_tokens", place(seed, F.col("full"), F.col("_id"), F.col("_text")).alias("_place"))
    sums = part.groupBy("leaf", "rest", F.substring("_place", 1, BUCKET_HEX).alias("bucket")).agg(F.sum("n_tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy("leaf").orderBy("bucket"))
    edge = sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("t")).filter("before <= rest and upto > rest")
    edge = cut(edge.select("leaf", "bucket", "before"))  # one bucket of each leaf
    last = with_small(part.withColumn("bucket", F.substring("_place", 1, BUCKET_HEX)), edge, ["leaf", "bucket"], "inner", LEAVES)
    last = last.groupBy("leaf", "rest", "before", "_place").agg(F.sum("n_tokens").alias("t"))
    run = F.col("before") + F.sum("t").over(Window.partitionBy("leaf").orderBy("_place"))
    fits = last.withColumn("run", run).filter("run <= rest").groupBy("leaf").agg(F.max("_place").alias("fit"))
    out = plan.join(edge, "leaf", "left").join(fits, "leaf", "left")
    return cut(out.select("leaf", "full", F.coalesce("fit", "bucket").alias("cutoff")))


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, float]], share: float = 0.5, total_tokens: int | None = None,
        max_epochs: int = 2, seed: int = 17, default_weight: float = 1.0, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per taken (document, epoch): the kept columns, the levels,
    ``n_tokens`` and ``epoch``.  The target is ``total_tokens`` or ``share`` of
    all tokens.  A document is taken where its place is at or before its leaf's
    cutoff, so texts are never shuffled for the choice."""
    names = list(levels)
    kept = {f"__kept_{i}": c for i, c in enumerate(keep or []) if c not in (*names, "n_tokens", "epoch")}
    new = docs.select(*[F.col(c).alias(n) for n, c in kept.items()],
                      *[v.cast("string").alias(n) for n, v in levels.items()], F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), n_tokens(F.col(text_col)).alias("n_tokens"))
    new = new.filter("n_tokens > 0").withColumn("leaf", leaf_key(names))
    rows = cut(new.select(*names, "leaf", "_id", F.md5("_text").alias("_text"), "n_tokens"))
    total = F.lit(total_tokens) if total_tokens is not None else F.floor(F.col("all_tokens") * share)
    plan = leaf_plan(rows, names, weights, total, max_epochs, default_weight, seed)
    if keep is None:
        new = rows.withColumn(id_col, F.col("_id"))
    else:
        new = new.withColumn("_text", F.md5("_text"))
    got = with_small(new, plan, ["leaf"], "inner", LEAVES)
    none = F.expr("cast(array() as array<int>)")
    whole = F.when(F.col("full") > 0, F.sequence(F.lit(0), F.col("full") - 1)).otherwise(none)
    part = F.when(place(seed, F.col("full"), F.col("_id"), F.col("_text")) <= F.col("cutoff"), F.array("full")).otherwise(none)
    return got.withColumn("epoch", F.explode(F.concat(whole, part))).select(
        *[F.col(n).alias(c) for n, c in kept.items()], *([F.col(id_col)] if keep is None and id_col not in names else []), *names, "n_tokens", "epoch")
