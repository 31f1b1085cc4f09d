"""Mix sources to target weights: capped water-filling, then seeded repetitions.

Targets: every source asks for a share of the budget by its weight; a source may be repeated
`max_epochs` times at most, and what the clamped sources cannot take is shared again by weight
among the others until no one is above its cap.  The fixed point of that rule is one water
level; it is found by sorting the sources by cap / weight.

Sampling: a source with target t and size s is taken floor(t / s) times as a whole, and the rest
in the order of a seeded hash of the id: documents go in whole until the rest is reached, and the
last one in part.  So each source meets its target to the word, no document exceeds
ceil(max_epochs) times its size, and reruns agree.

Scale: one aggregate over (source, hash range) finds the range in which each source's rest ends;
rows are ordered inside that one range only, so a source with a third of all rows is never in one
task.  The control table has one row per source.

Inside the range where a source's rest ends rows are ordered by hash, id, size and a hash of the text, in
parts cut along that order, so an id that many rows share (null, say) is spread over tasks.

Cases: null and wordless texts have size 0 and nothing taken; the null source is a source;
sources with no positive weight get nothing; a very long text is one row, counted by one expression; rows that tie in id
and size follow a hash of their text; repeated rows count each; an empty table gives an
empty result; other columns are carried, those named like a result are replaced (see `prefix`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, free_names, running_sum, small, word_count, words_of

#: Hash ranges per source: the first three hex digits of the hash, 4096.
DIGITS = 3
#: Up to so many sources their control table is broadcast (some 100 bytes a row); more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def water_fill(sources: DataFrame, budget_share: float, max_epochs: float) -> DataFrame:
    """Add `target` to a control table (source, source_size, weight).

    The budget is budget_share of all sizes.
    """
    everything = Window.partitionBy()
    rows = sources.withColumn("_w", F.when(F.col("weight") > 0, F.col("weight").cast("double"))).withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    rows = rows.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    before = everything.orderBy(F.col("_ratio").asc_nulls_last(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(everything) * F.lit(float(budget_share))
    left = budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    rows = rows.withColumn("_level", F.when(F.col("_w").isNotNull(), left / weight))
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", F.col("source").isNull(), "source", "_level"))).over(everything)
    target = F.when(F.col("_w").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.least("_cap", level["_level"] * F.col("_w")), F.col("_cap")))
    return rows.withColumn("target", target.cast("double")).drop("_w", "_cap", "_ratio", "_level")


def cycled_weights(sources: DataFrame, weights: list[float]) -> DataFrame:
    """Give the sources, by code point with null last, the weights in turn."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int")))


def mix(docs: DataFrame, weigh, budget_share: float = 1.0, max_epochs: float = 4.0, seed: int = 0, text: str = "text", source: str = "source", key: str = "doc_id", prefix: str = "_") -> DataFrame:
    """docs with _size, _source_size, _target, _whole (whole repetitions) and _part (words of one more, partial if below _size).

    `weigh` maps the control table (source, source_size) to one with a column weight.  The added columns'
    names begin with `prefix`; columns of docs with these names are replaced.
    """
    size, source_size, target, whole, part = (prefix + c for c in RESULT)
    docs = docs.drop(size, source_size, target, whole, part)
    order_, range_, cut_, at_, text_, s_ = free_names([*docs.columns, size, source_size, target, whole, part], "__order", "__range", "__cut", "__at", "__text", "__s")
    order = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    rows = docs.withColumn(size, word_count(F.col(text))).withColumn(order_, order)
    rows = rows.withColumn(range_, F.conv(F.substring(order_, 1, DIGITS), 16, 10).cast("int"))
    ranges = checkpointed(rows.groupBy(F.col(source).alias("source"), F.col(range_).alias("range")).agg(F.sum(size).alias("bytes")))
    sources = ranges.groupBy("source").agg(F.sum("bytes").alias("source_size"))
    plan = water_fill(weigh(sources), budget_share, max_epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = checkpointed(plan.withColumn("rest", F.floor("target") - F.col("whole") * F.col("source_size")))
    # at most 4096 rows a source
    upto = ranges.withColumn("before", F.coalesce(F.sum("bytes").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    a, b = plan.alias("a"), upto.alias("b")
    # the last range that begins before the rest is used up
    cut = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("b.before") < F.col("a.rest")), "left")
    cut = cut.groupBy(F.col("a.source").alias(s_), F.col("a.source_size").alias(source_size), F.col("a.target").alias(target), F.col("a.whole").alias(whole)).agg(
        F.max(F.struct(F.col("b.range").alias("at"), (F.col("a.rest") - F.col("b.before")).alias("left"))).alias(cut_)
    )
    cut = small(cut, plan.count(), BROADCAST_SOURCES)  # one row a source
    rows = rows.join(cut, rows[source].eqNullSafe(cut[s_])).withColumn(at_, F.coalesce(f"{cut_}.at", F.lit(-1)))
    # rows of one id and size follow a hash of their text, so reruns agree on them too
    inside = rows.filter(F.col(range_) == F.col(at_)).withColumn(text_, F.xxhash64(text))
    inside = running_sum(inside, s_, [order_, key, size, text_], size, f"{at_}_seen", inside.count())
    inside = inside.withColumn(part, F.greatest(F.lit(0), F.least(size, F.col(f"{cut_}.left") - F.col(f"{at_}_seen")))).drop(text_, f"{at_}_seen")
    outside = rows.filter(F.col(range_) != F.col(at_)).withColumn(part, F.when(F.col(range_) < F.col(at_), F.col(size)).otherwise(0))
    return outside.unionByName(inside).withColumn(part, F.col(part).cast("long")).drop(order_, range_, s_, cut_, at_)


#: What mix() adds, after its prefix.
RESULT = ("size", "source_size", "target", "whole", "part")


def taken(prefix: str = "_") -> Column:
    return F.col(prefix + "whole") * F.col(prefix + "size") + F.col(prefix + "part")


def repeated(mixed: DataFrame, columns: list[str], text: str = "text", n_chars: str | None = "n_chars", prefix: str = "_") -> DataFrame:
    """The mix itself: each document as often as it is taken, the partial repetition as its first words."""
    size, whole, part = (F.col(prefix + c) for c in ("size", "whole", "part"))
    (made,) = free_names(mixed.columns, "__text")
    full = F.array_repeat(F.col(text), (whole + ((part > 0) & (part == size)).cast("int")).cast("int"))
    full = F.when(size > 0, full).otherwise(F.array().cast("array<string>"))
    some = F.array_join(F.slice(words_of(F.col(text)), 1, part.cast("int")), " ")
    texts = F.concat(full, F.when((part > 0) & (part < size), F.array(some)).otherwise(F.array().cast("array<string>")))
    out = mixed.withColumn(made, F.explode(texts)).withColumn(text, F.col(made))
    if n_chars in columns:
        out = out.withColumn(n_chars, F.length(text).cast("long"))
    return out.select(*columns)
