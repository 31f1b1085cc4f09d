"""K-d tree sharding: cut the metadata space at weighted medians into shards of equal bytes.

A node that must yield k shards is cut where its bytes divide as floor(k/2) : ceil(k/2), along
the dimension in which it is widest, until every leaf is one shard or one row.  Only DataFrame functions
are used, and only a narrow table (id, size, coordinates) is read again and again; texts are
read once.

Coordinates are whole numbers that keep the order of whole values.  Whole numbers, dates and times are
taken as they are; all other values (strings, fractions, numbers beyond 2^61) by their rank among the
column's distinct values, which are sorted in ranges.  A null is one below the least value.

Rows have one order within a node: by its coordinate, then by a hash of all they hold, then by a number
of their own that tells equal rows apart.  A cut is found by refining a histogram along this order: the bytes
of each node are summed into BUCKETS ranges of the coordinate, the range that holds the cut is divided
again, until it is one value; rows that tie there are cut by the hash, and equal rows by their number.
A histogram has at most BUCKETS rows a node whatever the input, and the driver sees one row a node.

Shards are dealt to the two sides of a cut by their bytes, at least one each and no more than a side
has rows.  So every cut ends with two sides that have rows, and the tree is finite on every table: with
fewer rows than shards each row is a shard of its own and the last shards stay empty; one huge document is
a shard of its own, and the others share the rest.

Cases: null texts have no bytes (HEADER only); null coordinates sort first; very long texts are measured
and hashed inside the scan and not moved; ties in every coordinate are cut by hash, repeated rows by number
(which of two equal rows goes where is not told apart by any output column); an empty table gives an empty
result; other columns of docs are not read, and none can clash with those made here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, checkpointed, numbered, range_parts, small

#: Ranges a node's bytes are summed into at a time.
BUCKETS = 1 << 10
#: Whole numbers up to this are coordinates themselves.
PLAIN = 1 << 61
#: A document's fixed bytes beside its text.
HEADER = 8


def _number(df: DataFrame, name: str) -> Column | None:
    """A column of whole numbers, dates or times as a long; None for other types."""
    kind = dict(df.dtypes)[name]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.col(name).cast("long")
    if kind == "boolean":
        return F.col(name).cast("int").cast("long")
    if kind == "date":
        return F.unix_date(name).cast("long")
    if kind == "timestamp":
        return F.unix_micros(name)
    return None


def _ranks(values: DataFrame) -> tuple[DataFrame, int]:
    """(v, rank) of the distinct values of the one column v, from 0, and their number; nulls are left out."""
    values = checkpointed(values.filter("v IS NOT NULL").distinct())
    n = values.count()
    dealt = range_parts(values, ["v"], n, "part")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for every 100,000 values
    starts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy("v")
    return dealt.withColumn("k", F.row_number().over(inside) - 1).join(starts, "part").select("v", (F.col("start") + F.col("k")).cast("long").alias("rank")), n


def _coordinates(rows: DataFrame, docs_types: dict[str, Column | None], names: list[str]) -> DataFrame:
    """rows with c0, c1, .. in place of v0, v1, ..: whole numbers; null is one below the least."""
    plain = [i for i, n in enumerate(names) if docs_types[n] is not None]
    ends = rows.agg(*[f(f"v{i}").alias(f"{w}{i}") for i in plain for f, w in ((F.min, "lo"), (F.max, "hi"))]).first() if plain else {}
    for i in range(len(names)):
        if i in plain and (ends[f"lo{i}"] is None or (ends[f"lo{i}"] > -PLAIN and ends[f"hi{i}"] < PLAIN)):
            rows = rows.withColumn(f"c{i}", F.coalesce(f"v{i}", F.lit((ends[f"lo{i}"] or 0) - 1).cast("long")))
            continue
        ranks, n = _ranks(rows.select(F.col(f"v{i}").alias("v")))
        ranks = ranks.select(F.col("v").alias("_v"), F.col("rank").alias(f"c{i}"))
        # values may be long: left to Spark, which broadcasts by measured size and splits skewed joins
        rows = rows.join(ranks, F.col(f"v{i}") == F.col("_v"), "left").drop("_v").withColumn(f"c{i}", F.coalesce(f"c{i}", F.lit(-1).cast("long")))
    return rows.drop(*[f"v{i}" for i in range(len(names))])


def _table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small table; one row a node at most."""
    if not rows or len(rows) > 1000:
        return spark.createDataFrame(rows, ", ".join(f"{c} long" for c in columns.split()))
    values = ", ".join("(" + ", ".join(f"CAST('{int(x)}' AS BIGINT)" for x in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns.split())})")


def _cuts(rows: DataFrame, nodes: dict[int, dict], at: str) -> None:
    """For each node find the value of `at` in [lo, hi] at which the bytes below reach `want`.

    Sets node["lo"] to the value, lowers node["want"] by the bytes before it, adds these to node["bytes"] and their
    rows to node["rows"], and sets node["size"] and node["many"] to the bytes and rows at the value.
    """
    spark = rows.sparkSession
    open_nodes = dict(nodes)
    while open_nodes:
        table = [(k, v["lo"], v["hi"], max(1, -(-(v["hi"] - v["lo"] + 1) // BUCKETS)), v["want"]) for k, v in open_nodes.items()]
        near = rows.join(small(_table(spark, table, "node lo hi step want"), len(table)), "node").filter(F.col(at).between(F.col("lo"), F.col("hi")))
        bucket = F.floor((F.col(at) - F.col("lo")) / F.col("step")).cast("long") if max(r[3] for r in table) > 1 else F.col(at) - F.col("lo")
        sums = near.groupBy("node", "want", bucket.alias("bucket")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min(at).alias("low"), F.max(at).alias("high"))
        before = Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        upto = sums.withColumns({"done": F.coalesce(F.sum("bytes").over(before), F.lit(0)), "rows_done": F.coalesce(F.sum("n").over(before), F.lit(0))})
        # the first range that reaches the cut; with none, the last one
        reached = F.when(F.col("done") + F.col("bytes") >= F.col("want"), F.col("bucket")).otherwise(F.lit(2**62) - F.col("bucket"))
        met = upto.groupBy("node").agg(F.min_by(F.struct("done", "bytes", "n", "rows_done", "low", "high"), reached).alias("m"))
        for r in met.collect():
            v, m = open_nodes[r["node"]], r["m"]
            v["want"] -= m["done"]
            v["bytes"], v["rows"] = v["bytes"] + m["done"], v["rows"] + m["rows_done"]
            v["size"], v["many"] = m["bytes"], m["n"]
            v["lo"], v["hi"] = m["low"], m["high"]
        open_nodes = {k: v for k, v in open_nodes.items() if v["lo"] < v["hi"]}


def kd_shards(docs: DataFrame, dims: list[str], shards: int | None = None, target_bytes: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Columns key, size, text_crc32, shard and slot for each row of docs.

    Give the number of shards, or target_bytes for as many shards as hold that size each.
    """
    spark = docs.sparkSession
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    kinds = {d: _number(docs, d) for d in dims}
    values = [(F.col(d) if kinds[d] is None else kinds[d]).alias(f"v{i}") for i, d in enumerate(dims)]
    rows = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + HEADER).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        # 62 bits, so that differences stay whole numbers
        F.shiftright(F.xxhash64(body, F.col(key), *[F.col(d) for d in dims]), 2).alias("tie"),
        F.monotonically_increasing_id().alias("uid"),
        *values,
    )
    with Scratch(spark) as scratch:
        rows = scratch.keep(_coordinates(checkpointed(rows), kinds, dims).withColumn("node", F.lit(0).cast("long")))
        total = rows.agg(F.sum("size")).first()[0] or 0
        if shards is None:
            shards = max(1, math.ceil(total / target_bytes))
        leaves = _grow(rows, len(dims), shards, scratch)
        placed = checkpointed(leaves.select("key", "size", "text_crc32", "uid", F.col("shard").cast("int").alias("shard")))
    return numbered(placed, "shard", ["key", "text_crc32", "uid"], "slot").select(F.col("key").alias(key), "size", "text_crc32", "shard", "slot")


def _grow(rows: DataFrame, dims: int, shards: int, scratch: Scratch) -> DataFrame:
    """rows (node 0) with `shard`."""
    spark = rows.sparkSession
    names = [f"c{i}" for i in range(dims)]
    leaves = {0: (0, shards)}  # node -> first shard and number of shards
    reach: list[int] = []
    while True:
        open_nodes = [n for n, (_, k) in leaves.items() if k > 1]
        if not open_nodes:
            break
        wanted = small(_table(spark, [(n,) for n in open_nodes], "node"), len(open_nodes))
        ends = [f(c).alias(f"{w}_{c}") for c in [*names, "tie", "uid"] for f, w in ((F.min, "lo"), (F.max, "hi"))]
        stats = {r["node"]: r for r in rows.join(wanted, "node").groupBy("node").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), *ends).collect()}
        if not reach and stats:
            reach = [max(1, stats[0][f"hi_{c}"] - stats[0][f"lo_{c}"]) for c in names]
        cuts = {}
        for node in open_nodes:
            s, k = stats.get(node), leaves[node][1]
            if s is None or s["n"] < 2:  # no row or one: nothing to cut
                leaves[node] = (leaves[node][0], 1)
                continue
            width = [(s[f"hi_{c}"] - s[f"lo_{c}"]) / r for c, r in zip(names, reach)]
            dim = max(range(dims), key=lambda i: width[i])
            cuts[node] = {"dim": dim, "lo": s[f"lo_c{dim}"], "hi": s[f"hi_c{dim}"], "want": s["bytes"] * (k // 2) // k, "bytes": 0, "rows": 0, "all": s}
        if not cuts:
            break
        pick = F.lit(None).cast("long")
        for i in range(dims):
            pick = F.when(F.col("dim") == i, F.col(f"c{i}")).otherwise(pick)
        along = small(_table(spark, [(n, c["dim"]) for n, c in cuts.items()], "node dim"), len(cuts))
        near = rows.join(along, "node").select("node", "size", "tie", "uid", pick.alias("at"))
        _cuts(near, cuts, "at")
        at = {n: c["lo"] for n, c in cuts.items()}
        for column, held in (("tie", "cut"), ("uid", "cut_tie")):  # the order goes on among rows that tie so far
            tied = {n: c for n, c in cuts.items() if c["many"] > 1}
            if tied:
                fixed = _table(spark, [(n, at[n], c["lo"]) for n, c in tied.items()], "node cut cut_tie")
                equal = (F.col("at") == F.col("cut")) & ((F.col("tie") == F.col("cut_tie")) if column == "uid" else F.lit(True))
                some = near.join(small(fixed, len(tied)), "node").filter(equal).select("node", "size", "tie", "uid")
                for n, c in tied.items():
                    c["lo"], c["hi"] = c["all"][f"lo_{column}"], c["all"][f"hi_{column}"]
                _cuts(some, tied, column)
            for n, c in cuts.items():
                c[column] = c["lo"] if n in tied else None
        split, grown = [], {n: x for n, x in leaves.items() if n not in cuts}
        for n, c in cuts.items():
            s, (first, k) = c["all"], leaves[n]
            # the row the cut falls into goes to the side that has more of it; both sides keep a row
            over = (2 * c["want"] > c["size"] or c["rows"] == 0) and c["rows"] + 1 < s["n"]
            low_rows, low_bytes = c["rows"] + over, c["bytes"] + over * c["size"]
            share = round(k * low_bytes / s["bytes"])
            low = max(1, min(share, k - 1, low_rows))
            high = max(1, min(k - low, s["n"] - low_rows))
            low = max(low, min(k - high, low_rows))
            # a missing tie or number: the row is alone at its value, below or above the cut as a whole
            rest = [x + over if i == 2 else x for i, x in enumerate((at[n], c["tie"], c["uid"])) if x is not None]
            if len(rest) < 3:
                rest[-1] += over
            rest += [-(2**63)] * (3 - len(rest))
            split.append((n, c["dim"], *rest))
            grown[(n, 0)], grown[(n, 1)] = (first, low), (first + low, high)
        # nodes are numbered anew, so that numbers stay small however deep the tree
        new = {old: i for i, old in enumerate(grown)}
        moves = [(n, d, a, b, c, new[(n, 0)], new[(n, 1)]) for n, d, a, b, c in split]
        moves += [(n, -1, 0, 0, 0, new[n], new[n]) for n in leaves if n not in cuts]
        table = small(_table(spark, moves, "node dim cut cut_tie cut_uid low high"), len(moves))
        a, b, u = pick, F.col("tie"), F.col("uid")
        below = (a < F.col("cut")) | ((a == F.col("cut")) & ((b < F.col("cut_tie")) | ((b == F.col("cut_tie")) & (u < F.col("cut_uid")))))
        moved = rows.join(table, "node").withColumn("node", F.when(below, F.col("low")).otherwise(F.col("high")))
        rows = scratch.keep(moved.drop("dim", "cut", "cut_tie", "cut_uid", "low", "high"))  # one level a table, so plans stay small
        leaves = {new[old]: x for old, x in grown.items()}
    table = _table(spark, [(n, first) for n, (first, _) in leaves.items()], "node shard")
    return rows.join(small(table, len(leaves)), "node")
