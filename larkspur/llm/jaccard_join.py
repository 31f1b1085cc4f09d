"""N-gram Jaccard join by T-occurrence search over inverted lists, in the manner of DivideSkip.

A document is its set of five-word shingles (62-bit hashes).  Two sets of sizes m and n link when they
share at least T = ceil(0.8 / 1.8 * (m + n)) shingles.  DivideSkip splits the inverted lists of a query
into short ones, which are merged, and long ones, which are only probed:

* shingles have one global order, rare before frequent.  Of a set of size n only the lists of its
  n - ceil(0.8 n) + 1 first shingles are merged: two sets that link share one of these, whatever
  the order, so the order decides speed alone.  Shingles in more than FREQUENT of the documents are
  counted over all documents and come last, by frequency; the others come by hash.
* the lists of all other shingles are never built.  A candidate is probed by binary search of
  the query's shingles in the candidate's sorted set, from the rare end, until T is met or out of reach.

Equal sets are one class first.  A sketch drops list entries that no other class has.  Lists are then
merged twice.  First each list is merged with one pivot, the class of which most short lists are shared;
that makes as many pairs as list entries, and joins a group of near copies to a few components.
Then, for lists that still hold several components, entries outside the list's main component
meet all entries of others: that finds every link left, without the pairs inside a component.
In both, a pair passes only if it shares as many merged shingles as T needs (the count of the merge).

Nothing is capped, and no list, component or link is collected: hot lists are pre-aggregated for
their pivot and joined by adaptive skew joins.

Cases: a null or wordless text has the empty set and links with nothing; a text of fewer words
than a shingle is one shingle; rows are documents, whatever their ids: of rows that share an id, or have none, each has the
links of its own text only; a component's id is the least that is not null; a very long text is one
Arrow row, hashed in pieces, and a pair is probed with both sets (8 bytes a shingle) in memory; repeated rows are one class; shingles
that tie in frequency go by hash; an empty table gives an empty result; ids are whole numbers (others are cast, and raise where
they cannot be); other columns of docs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytehash import hash_spans, mixed, pieces, text_bytes, tidied, window_hashes, word_spans
from .common import Scratch, checkpointed
from .components import components
from .sketch import maybe_member, maybe_repeated, members, repeated_bits, sketch_bits

SHINGLE = 5
#: The threshold as a ratio of whole numbers.
NUM, DEN = 4, 5
#: A shingle in more than this part of the documents is frequent.  At most (mean set size) / FREQUENT
#: shingles are, so their table does not grow with the number of documents.
FREQUENT = 0.001
#: Shingles that a task counts together, which bounds its memory.
COUNTED = 1_500_000
#: Shingles of sets that a Python worker sends together.
SENT = 500_000
#: Rows of two sets each that reach a Python worker together, and their bytes.
PROBED, PROBED_BYTES = 500, 8 << 20
#: List entries to expect of a document; sizes the sketch and decides nothing else.
ENTRIES_PER_DOCUMENT = 128
_HEAVY = 1 << 62


def shingle_sets(batch: pa.RecordBatch, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(id, sorted distinct 62-bit shingle hashes) of each row (id, text); A-Z count as a-z."""
    data, offsets = text_bytes(batch.column(1))
    ids = batch.column(0).to_numpy()
    for lo, hi in pieces(offsets):
        body, inner = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, stops, first = word_spans(body, inner)
        words = hash_spans(body, starts, stops, lower=True)
        grams = window_hashes(words, size) >> np.uint64(2)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= size:
                one = np.unique(grams[a : b - size + 1])
            else:  # a sequence of fewer words, apart from all shingles by its length
                one = mixed(window_hashes(words[a:b], int(b - a)) + np.uint64(b - a)) >> np.uint64(2) if b > a else np.zeros(0, dtype=np.uint64)
            yield int(ids[lo + i]), one.view(np.int64)


def _class_of(one: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set."""
    x = mixed(one.view(np.uint64))
    return int(x.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(x * np.uint64(0x9E3779B97F4A7C15) ^ (x >> np.uint64(7))).view(np.int64)) if len(x) else 0


def _least_overlap(n: int) -> int:
    """The shingles a set of size n shares at least with any that links."""
    return -(-NUM * n // DEN)


def needed(m: Column, n: Column) -> Column:
    """Shared shingles needed between sets of sizes m and n: |x & y| * DEN >= NUM * |x | y|."""
    total = NUM * (m + n)
    return ((total + (NUM + DEN - 1)) / (NUM + DEN)).cast("long")


def _facts(texts: DataFrame) -> DataFrame:
    """In one pass over (k, t, id): id, k, n, c1, c2 (the class) of each row, and token, count of shingles that are frequent in a batch, equal sets counted once."""

    names = ["id", "k", "n", "c1", "c2", "token", "count"]

    def counted(sets: dict, ids: pa.Array, rows: list) -> Iterator[pa.RecordBatch]:
        columns = [pa.array(np.array(x, dtype=np.int64)) for x in zip(*rows)]
        yield pa.RecordBatch.from_arrays([ids, *columns, *[pa.nulls(len(rows), pa.int64())] * 2], names=names)
        if sets:
            tokens = np.concatenate(list(sets.values()))
            tokens.sort()
            first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
            n = np.diff(np.append(first, len(tokens)))
            keep = n >= max(2, FREQUENT * len(rows))
            yield pa.RecordBatch.from_arrays([*[pa.nulls(int(keep.sum()), pa.int64())] * 5, pa.array(tokens[first[keep]]), pa.array(n[keep].astype(np.int64))], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, rows, size, at = {}, [], 0, 0
            for k, one in shingle_sets(batch):
                name = _class_of(one)
                rows.append((k, len(one), *name))
                if len(one) and name not in sets:
                    sets[name] = one
                    size += len(one)
                if size > COUNTED:
                    yield from counted(sets, batch.column(2).slice(at, len(rows)), rows)
                    at += len(rows)
                    sets, rows, size = {}, [], 0
            if rows:
                yield from counted(sets, batch.column(2).slice(at, len(rows)), rows)

    return texts.mapInArrow(tidied(read), "id long, k long, n long, c1 long, c2 long, token long, count long")


def _frequent(facts: DataFrame, docs: int) -> np.ndarray:
    """The frequent shingles, rarest first."""
    counts = facts.filter("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("n"))
    rows = counts.filter(F.col("n") > F.lit(max(2.0, FREQUENT * docs))).toPandas().sort_values(["n", "token"])
    return rows["token"].to_numpy(dtype=np.int64)


def _only(batch: pa.RecordBatch, tables: list[np.ndarray]) -> pa.RecordBatch:
    """The rows (id, text) whose id may be in the tables."""
    ids = batch.column(0).to_numpy()
    return batch.filter(pa.array(maybe_member(tables, ids)))


def _short_lists(texts: DataFrame, reps: DataFrame, frequent: np.ndarray) -> DataFrame:
    """rep, n and short: the first shingles of each representative's set in the global order, as order values.

    Texts are picked by a sketch of the representatives, not by a join that would move all texts.  A
    copy that slips through is a set like its representative's, and links with it.
    """
    by_token = np.argsort(frequent)
    sc = texts.sparkSession.sparkContext
    table, wanted = sc.broadcast((frequent[by_token], by_token)), sc.broadcast(members(reps))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, rank = table.value
        for batch in batches:
            ids, sizes, short = [], [], []
            for k, one in shingle_sets(_only(batch, wanted.value)):
                if not len(one):
                    continue
                want = len(one) - _least_overlap(len(one)) + 1
                order = one
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, one), len(tokens) - 1)
                    heavy = tokens[at] == one
                    order = one[~heavy][:want]
                    if len(order) < want:
                        order = np.concatenate([order, np.sort(rank[at[heavy]])[: want - len(order)] + _HEAVY])
                ids.append(k), sizes.append(len(one)), short.append(order[:want])
                if len(ids) == 1000:
                    yield _signed(ids, sizes, short)
                    ids, sizes, short = [], [], []
            if ids:
                yield _signed(ids, sizes, short)

    return texts.mapInArrow(tidied(sign), "rep long, n long, short binary")


def _signed(ids: list[int], sizes: list[int], short: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array([x.astype(np.int64).tobytes() for x in short], pa.binary())], names=["rep", "n", "short"])


def _entries(short: DataFrame) -> DataFrame:
    """List entries that another class may share: token, rep, n, dead (merged shingles of the set that no other class has among its own), last (the largest order value merged)."""
    session = short.sparkSession

    def names(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        body = b"".join(batch.column(0).to_pylist())
        if body:
            yield mixed(np.frombuffer(body, dtype=np.uint64))

    bits = session.sparkContext.broadcast(repeated_bits(short.select("short"), names, sketch_bits(ENTRIES_PER_DOCUMENT * short.count())))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for rep, n, held in zip(*(batch.column(i).to_pylist() for i in range(3))):
                order = np.frombuffer(held, dtype=np.int64)
                alive = order[maybe_repeated(bits.value, mixed(order.view(np.uint64)))]
                if len(alive):
                    rows.append((alive, rep, n, len(order) - len(alive), order[-1]))
                    size += len(alive)
                if size > 100_000:
                    yield _listed(rows)
                    rows, size = [], 0
            if rows:
                yield _listed(rows)

    return short.select("rep", "n", "short").mapInArrow(tidied(entries), "token long, rep long, n long, dead int, last long")


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    sizes = [len(r[0]) for r in rows]
    columns = [pa.array(np.concatenate([r[0] for r in rows]))]
    for i, kind in ((1, np.int64), (2, np.int64), (3, np.int32), (4, np.int64)):
        columns.append(pa.array(np.repeat(np.array([r[i] for r in rows], dtype=kind), sizes)))
    return pa.RecordBatch.from_arrays(columns, names=["token", "rep", "n", "dead", "last"])


def _met(a: DataFrame, b: DataFrame, more: Column) -> DataFrame:
    """Pairs (x, y) from entries of common lists that share as many merged shingles as a link needs.

    Of two sets the one whose merged shingles end first has all of them below the other's end, so
    those it does not share there it does not share at all.
    """
    a, b = a.alias("a"), b.alias("b")
    need = needed(F.col("a.n"), F.col("b.n"))
    ends_first = F.col("a.last") <= F.col("b.last")
    n, dead = (F.when(ends_first, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")) for c in ("n", "dead"))
    joined = a.join(b, (F.col("a.token") == F.col("b.token")) & more & (F.least("a.n", "b.n") >= need) & (n - dead >= need))
    merged = n - F.floor((NUM * n + (DEN - 1)) / DEN) + 1
    rows = joined.select(F.least("a.rep", "b.rep").alias("x"), F.greatest("a.rep", "b.rep").alias("y"), (need - n + merged).alias("shared_needed"))
    return rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("shared"), F.min("shared_needed").alias("shared_needed")).filter(F.col("shared") >= F.col("shared_needed")).select("x", "y")


def _linked(pairs: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (x, y) whose sets share enough shingles.

    Texts are picked by a sketch of the ids, so only sets that are asked for are made and moved.
    """
    ids = scratch.keep(pairs.select(F.col("x").alias("k")).union(pairs.select(F.col("y").alias("k"))).distinct())
    wanted = texts.sparkSession.sparkContext.broadcast(members(ids))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, size = [], [], 0
            for k, one in shingle_sets(_only(batch, wanted.value)):
                ids.append(k), held.append(one.tobytes())
                size += len(one)
                if size > SENT:
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(held, pa.binary())], names=["k", "s"])
                    ids, held, size = [], [], 0
            if ids:
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(held, pa.binary())], names=["k", "s"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = np.frombuffer(a, dtype=np.int64), np.frombuffer(b, dtype=np.int64)
                if len(x) > len(y):
                    x, y = y, x
                need = -(-NUM * (len(x) + len(y)) // (NUM + DEN))
                shared, done = 0, 0
                while len(x) and done < len(x) and shared < need <= shared + len(x) - done:
                    some = x[done : done + 256]
                    at = np.searchsorted(y, some)
                    shared += int((y[np.minimum(at, len(y) - 1)] == some).sum())
                    done += len(some)
                keep.append(bool(len(x)) and shared >= need)
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(pa.array(keep, pa.bool_())), batch.column("y").filter(pa.array(keep, pa.bool_()))], names=["x", "y"])

    held = scratch.keep(texts.mapInArrow(tidied(sets), "k long, s binary"))
    session = texts.sparkSession
    both = pairs.join(held.select(F.col("k").alias("x"), F.col("s").alias("a")), "x").join(held.select(F.col("k").alias("y"), F.col("s").alias("b")), "y")
    # both sets travel with a pair, so a batch is bounded by bytes: sets of long texts come few at a time
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": PROBED, "spark.sql.execution.arrow.maxBytesPerBatch": PROBED_BYTES}
    before = {k: session.conf.get(k, None) for k in bounds}
    try:
        for k, v in bounds.items():
            session.conf.set(k, str(v))
        return scratch.keep(both.select("x", "y", "a", "b").mapInArrow(tidied(probe), "x long, y long").distinct())
    finally:
        for k, v in before.items():
            session.conf.unset(k) if v is None else session.conf.set(k, v)


def _links(entries: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (x, y) between classes; their components are those of all links."""
    # each list with its pivot: the class with the largest part of its merged shingles shared
    columns = ["rep", "n", "dead", "last"]
    weight = F.struct((F.col("dead") / F.col("n")).alias("lost"), *columns)
    # aggregates are kept as tables: joins of plain exchanges can split the rows of a hot list
    lists = entries.groupBy("token").agg(F.min(weight).alias("v"), F.count(F.lit(1)).alias("length")).filter("length > 1").select("token", *[F.col(f"v.{c}").alias(c) for c in columns])
    lists = scratch.keep(lists)
    links = _linked(scratch.keep(_met(entries, lists, F.col("a.rep") != F.col("b.rep"))), texts, scratch)

    joined = components(links)
    placed = scratch.keep(entries.join(joined, entries["rep"] == joined["node"], "left").select(*entries.columns, F.coalesce("component", "rep").alias("part")))
    per_part = placed.groupBy("token", "part").agg(F.count(F.lit(1)).alias("c"))
    mains = per_part.groupBy("token").agg(F.max(F.struct("c", "part")).alias("m"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("token", F.col("m.part").alias("main"))
    open_lists = scratch.keep(placed.join(scratch.keep(mains), "token"))
    # pairs outside the main part are met from one side only
    apart = (F.col("a.part") != F.col("b.part")) & ((F.col("b.part") == F.col("b.main")) | (F.col("a.rep") < F.col("b.rep")))
    return links.union(_linked(scratch.keep(_met(open_lists.filter("part != main"), open_lists, apart)), texts, scratch))


def named_rows(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """k (a 64-bit hash of id and text, a row's name), id (the key as a long) and t."""
    return docs.select(F.xxhash64(key, F.col(key).isNull(), text).alias("k"), F.col(key).cast("long").alias("id"), F.col(text).alias("t"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles and component_id (the least key reachable by links; null only where no row reached has one) for each row of docs."""
    rows = named_rows(docs, text, key)
    texts = rows.select("k", "t")
    facts = checkpointed(_facts(rows.select("k", "t", "id")))
    signed = facts.filter("token IS NULL").select("k", "id", "n", "c1", "c2")
    classes = checkpointed(signed.filter("n > 0").groupBy("c1", "c2", "n").agg(F.min("k").alias("rep"), F.min("id").alias("least")))
    reps = classes.select("c1", "c2", F.col("n").alias("cn"), "rep", "least")
    placed = signed.alias("s").join(reps.alias("r"), (F.col("s.c1") == F.col("r.c1")) & (F.col("s.c2") == F.col("r.c2")) & (F.col("s.n") == F.col("r.cn")), "left")
    placed = checkpointed(placed.select("id", F.col("s.n").alias("n"), "rep", F.when(F.col("rep").isNull(), F.col("id")).otherwise(F.col("least")).alias("least")))
    with Scratch(docs.sparkSession) as scratch:
        short = scratch.keep(_short_lists(texts, classes.select("rep"), _frequent(facts, signed.count())))
        groups = components(_links(scratch.keep(_entries(short)), texts, scratch))
        # one row a class that links with another; the least key of a component is that of its classes
        grouped = scratch.keep(classes.select("rep", "least").join(groups, F.col("rep") == F.col("node")).select("rep", "least", "component"))
        tops = scratch.keep(grouped.groupBy("component").agg(F.min("least").alias("top")))
        moved = checkpointed(grouped.join(tops, "component").select(F.col("rep").alias("node"), "top"))

    out = placed.join(moved, placed["rep"] == moved["node"], "left")
    component = F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("top"))
    return out.select(F.col("id").cast(docs.schema[key].dataType).alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
