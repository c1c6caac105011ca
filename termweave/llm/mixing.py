"""Mixing sources to target weights: capped water-filling and seeded repetitions, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm.common import WORD, fits, join_spread, passing, small, stored, text_of

#: Digits of the seeded order by which the fractional repetition's end is looked for: 60 bits, 12 at a time.
ORDER_BITS, DIGIT_BITS = 60, 12


def word_count(col: str = "text") -> Column:
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")


def seeded_order(key: Column, seed: int) -> Column:
    """A number in [0, 2**60) from the first 15 hex digits of md5("seed:key"); null keys hash as the empty text."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, max_epochs: float) -> DataFrame:
    """Water-filling over (source_key, source, source_size): adds weight, target, epochs (whole) and need (words of the fractional one).

    A source is clamped at max_epochs of its size. Sorted by clamp over weight, the clamped ones are a
    prefix; the level is the first at which what the prefix leaves of the budget, shared by weight over
    the rest, exceeds no clamp. That is what clamping and resharing in turn converge to. The table has a
    row for each source; weights go by the source's place in code-point order, null last, repeating.
    """
    whole = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(whole) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("clamp", F.col("source_size") * float(max_epochs))
    by_clamp = Window.orderBy(F.col("clamp") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_clamp.rowsBetween(Window.unboundedPreceding, -1), by_clamp.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (
        ranked.withColumn("total", F.sum("source_size").over(every) * float(budget))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("clamp").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("clamp"), F.struct(F.col("clamp") / F.col("weight"), "level"))).over(every)["level"])
    )
    target = F.coalesce(F.least(F.col("clamp"), F.col("level") * F.col("weight")), F.col("clamp"))
    size = F.col("source_size")
    return (
        level.withColumn("target", target)
        .withColumn("epochs", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long"))
        .withColumn("need", F.round("target").cast("long") - F.col("epochs") * size)
        .select("source_key", "source_size", "weight", "target", "epochs", "need")
    )


def _descend(rows: DataFrame, plan: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """One digit of each source's cut: the digit in which the running sum reaches need.

    rows: (source_key, place, size) of those whose earlier digits are the cut's. Returns the rows that stay
    and the plan with need lowered by the sum of the digits before. Sums are partial before the shuffle,
    and a source has at most 4096 of them.
    """
    shift = ORDER_BITS - DIGIT_BITS * level
    digit = F.shiftright("place", shift) % (1 << DIGIT_BITS)
    rows = rows.withColumn("digit", digit)
    order = Window.partitionBy("source_key").orderBy("digit")
    sums = rows.groupBy("source_key", "digit").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(order))
    cut = (
        sums.join(plan.select("source_key", "need"), "source_key")
        .where((F.col("need") > 0) & (F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("words") < F.col("need")))
        .groupBy("source_key").agg(F.min(F.struct("digit", (F.col("need") - F.col("upto") + F.col("words")).alias("need"))).alias("x"))
        .select("source_key", F.col("x.digit").alias("at"), F.col("x.need").alias("need"))
    )
    cut = small(stored(cut))
    return rows.join(cut.select("source_key", F.col("at").alias("digit")), ["source_key", "digit"]).drop("digit"), cut.select("source_key", "need")


def mix(
    df: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, max_epochs: float = 2.0, seed: int = 20,
    key: str = "doc_id", source: str = "source", text: str = "text", keep: list[str] | None = None, prefix: str = "mix_",
) -> DataFrame:
    """Every row of df with mix_size, mix_source_size, mix_target and mix_taken (words that the mix takes of it, repeats counted).

    Each row is taken whole floor(target / source size) times. The fractional repetition takes rows in
    seeded order until the target is met; the row at the cut is taken in part. Rows at the same place in
    that order (repeated rows: same key and size) share its words evenly, rounded down. So a source's taken
    words differ from its target by less than the number of rows at the cut.

    keep: columns to carry besides the key and the source (default: all of df's). Null or blank texts have
    size 0 and take 0; null keys are placed like an empty key; a null source is a source of its own, last
    in order; very long texts are counted whole; an empty table gives an empty table. Columns of df named like the added ones,
    which begin with prefix, are replaced.
    """
    added = {prefix + c: c for c in ("size", "source_size", "target", "taken")}
    kept = [c for c in (df.columns if keep is None else [key, source, *keep]) if c not in added]
    kept = list(dict.fromkeys(kept))
    row = F.struct(*kept).alias("row")
    size = word_count(text)
    base = df.select(row, F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-")).alias("source_key"), F.col(source).alias("source"), size.alias("size"), F.col(key).alias("key"))
    base = base.withColumn("place", seeded_order(F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("")), F.col("size").cast("string")), seed)).drop("key")
    with passing(df.sparkSession) as keep:
        compact = stored(base.select("source_key", "source", "size", "place"))
        sizes = compact.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
        plan = stored(source_targets(sizes, weights, budget, max_epochs))

        rows, need = compact.select("source_key", "place", "size"), plan.select("source_key", "need")
        for level in (1, 2):
            rows, need = _descend(rows, need, level)
        order = Window.partitionBy("source_key").orderBy("place")
        cut = (
            rows.groupBy("source_key", "place").agg(F.sum("size").alias("words"), F.count("*").alias("n")).withColumn("upto", F.sum("words").over(order)).join(need, "source_key")
            .where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("words") < F.col("need")))
            .groupBy("source_key").agg(F.min(F.struct("place", F.floor((F.col("need") - F.col("upto") + F.col("words")) / F.col("n")).cast("long").alias("part"))).alias("x"))
            .select("source_key", F.col("x.place").alias("cut"), F.col("x.part").alias("part"))
        )
        plan = keep(stored(plan.join(cut, "source_key", "left")))
        n_rows = compact.count()
    partial = F.when(F.col("place") < F.col("cut"), F.col("size")).when(F.col("place") == F.col("cut"), F.least("part", "size")).otherwise(0)
    base = base.drop("source")
    # Few sources are broadcast; of more, each is dealt over several tasks by its rows' places.
    met = base.join(F.broadcast(plan), "source_key") if fits(plan) else join_spread(base, plan, "source_key", "place", n_rows)
    out = met.withColumn("taken", (F.col("epochs") * F.col("size") + partial).cast("long"))
    return out.select(*(F.col("row")[c].alias(c) for c in kept), *(F.col(c).alias(name) for name, c in added.items()))


def copies(df: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of df as often as it is taken; the one at a source's cut counts as taken if at least half of it is."""
    prefix = "mix_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    mixed = mix(df, prefix=prefix, **options)
    size, taken, target, whole = (F.col(prefix + c) for c in ("size", "taken", "target", "source_size"))
    times = F.when(size > 0, F.round(taken / size)).otherwise(F.floor(target / F.greatest(whole, F.lit(1)))).cast("int")
    each = F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))
    return mixed.withColumn(prefix + "copy", each).select(*df.columns)
