"""Document fingerprints: the k smallest hashes of a text's five-word shingles.

A fingerprint is a sorted array of at most K distinct 64-bit hashes.  The fingerprint of a union is
the K smallest of both fingerprints, so parts can be made anywhere and merged.  Of two fingerprints
the K smallest of the union are a uniform sample of the union's shingles; the part of them that
both hold estimates resemblance.  Below K shingles everything is exact.

DataFrame functions only.  Cases: a null or wordless text has the empty fingerprint, which is like
another empty one (1) and unlike any other (0); a text of fewer than five words is one shingle; a very long
text's hashes (8 bytes a word) are in memory at once, inside one row; equal texts, repeated rows among them, have equal
fingerprints, and shingles that tie are one; an empty table gives an empty result; columns of docs that are
named like a result (fingerprint, distinct_shingles, next_<name>) are replaced, all others are carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, words_of

SHINGLE = 5
K = 256


def _let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.transform(F.array(value), body)[0]


def fingerprint(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    hashes = F.transform(words_of(text), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - shingle, F.lit(0)))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(shingle)])))

    return F.slice(F.sort_array(F.array_distinct(_let(hashes, shingles))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated size of the intersection over that of the union."""
    some = merged(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), some))
    return F.when(F.size(some) == 0, F.lit(1.0)).otherwise(shared / F.size(some)).cast("double")


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k, else from the k-th smallest hash."""
    part = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / part)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of a's shingles that b holds."""
    both = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """A fingerprint as hexadecimal numbers."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.hex(h))), " ")


def with_next(docs: DataFrame, columns: dict[str, Column], then: dict[str, Column] | None = None, key: str = "doc_id", rows_per_range: int = 4000) -> DataFrame:
    """docs with next_<name> for each expression in `columns`, taken from the next row by key (after the last: the first).

    `then` adds columns, made once the first are there, and their next_<name> in turn.
    The key is a whole number; null comes before all, and rows of one key follow a hash of all their columns, so
    reruns agree.  Rows are dealt by ranges of (key, hash), whose bounds come from a narrow table of both, and the
    first row of each range also goes to the end of the range before it: no task sees all rows, however
    many share a key.  Columns of docs named next_<name> are replaced.
    """
    v, t, at, block, to, range_, extra = free_names([*docs.columns, *columns, *(then or {})], "__v", "__t", "__at", "__block", "__to", "__range", "__extra")
    value = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    docs = docs.withColumns({v: value, t: F.xxhash64(*docs.columns)})
    n = docs.count()
    many = max(1, min(1 << 16, n // rows_per_range))
    parts = docs.select(v, t).repartitionByRange(many, v, t).groupBy(F.spark_partition_id()).agg(F.min(F.struct(v, t)).alias("m"))
    # one row a range
    bounds = sorted({(r["m"][0], r["m"][1]) for r in parts.collect()}) if many > 1 else []
    if not bounds:
        bounds = [tuple(r) for r in docs.select(v, t).orderBy(v, t).limit(1).collect()] or [(0, 0)]
    side = max(1, math.isqrt(len(bounds)))

    def numbers(values: list[tuple[int, int]]) -> Column:  # folded to one literal
        one, two = (F.split(F.lit(",".join(str(x[i]) for x in values)), ",").cast("array<bigint>") for i in (0, 1))
        return F.arrays_zip(one.alias("v"), two.alias("t"))

    own_place = F.struct(F.col(v).alias("v"), F.col(t).alias("t"))
    upto = lambda some: F.size(F.filter(some, lambda b: b <= own_place)) - 1
    placed = docs.withColumn(block, upto(numbers(bounds[::side])))
    placed = placed.withColumn(at, F.col(block) * side + upto(F.slice(numbers(bounds), F.col(block) * side + 1, side)))
    own = F.struct(F.col(at).alias("range"), F.lit(0).alias("extra"))
    copy = F.struct(F.pmod(F.col(at) - 1, F.lit(len(bounds))).alias("range"), F.lit(1).alias("extra"))
    first = F.get(numbers(bounds), F.col(at)) == own_place
    placed = placed.withColumn(to, F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own))))
    placed = placed.withColumns({range_: F.col(f"{to}.range"), extra: F.col(f"{to}.extra")})  # plain columns, so both windows share one exchange
    order = Window.partitionBy(range_).orderBy(extra, v, t)
    out = placed.drop(block, at, to).withColumns({f"next_{c}": F.lead(e).over(order) for c, e in columns.items()})
    if then:
        out = out.withColumns(then)
        out = out.withColumns({f"next_{c}": F.lead(c).over(order) for c in then})
    return out.filter(F.col(extra) == 0).drop(range_, extra, v, t)


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K) -> DataFrame:
    """docs with `fingerprint` and the estimated `distinct_shingles`."""
    out = docs.withColumn("fingerprint", fingerprint(F.col(text), k))
    return out.withColumn("distinct_shingles", distinct_shingles(F.col("fingerprint"), k))
