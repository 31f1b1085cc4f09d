"""Substring dedup: remove words covered by 50-word windows that an earlier document holds too.

First pass: every document adds its windows to a count-min sketch, once for each window.  A window is
entered under the least hash of its 20-word runs, so the dozen or so windows around one such run share
an entry; a window's estimate is never below the number of documents that hold it.  Partial
sketches are merged block by block (sketch.py).
Second pass: windows estimated repeated are grouped exactly (96-bit hashes of the word sequence) for
their first and last document.  Third: their places are joined with the windows that have an earlier
document, places are merged per document, and the covered words go.

Nothing repeated is lost: a fuller sketch only lets more windows into the exact pass.  Both passes
pre-aggregate in each task, so a window in a third of all documents is one row a task; the join is
left to adaptive execution, which splits skewed partitions.

Places belong to a document's id and a 64-bit hash of its text, so rows that share an id, or have none, lose only
what their own text repeats.

Cases: a null text has no words; fewer words than a window are left alone; a very long text is one Arrow row, hashed
in pieces of a few MB, and its places are one row of four bytes a word at most; a null id comes before
all others and loses nothing; rows that share an id are equally early, so none takes words from another, and
rows that share id and text fare alike; an empty table gives an empty result; ids are whole numbers (others are cast,
and raise where they cannot be); other columns of docs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import hash_spans, mixed, pieces, text_bytes, window_hashes, word_spans
from .common import Scratch, checkpointed
from .sketch import maybe_member, maybe_repeated, members, repeated_bits, sketch_bits

WINDOW = 50
#: Words of the runs that name a window in the sketch.
GRAM = 20
#: Sketch entries to expect of a document; sizes the sketch and decides nothing else.
NAMES_PER_DOCUMENT = 64
_OTHER = np.uint64(0xA24BAED4963EE407)
_NULL = -(2**63)


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The least of every `size` consecutive entries."""
    span = 1
    while 2 * span <= size:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (size - span)], x[size - span :])


def _windows(batch: pa.RecordBatch, window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For pieces of a batch (id, hash, text): ids and hashes, and for each window its document's number in the piece, its first word, its word hashes' start, and its name; with the piece's word hashes."""
    data, offsets = text_bytes(batch.column(2))
    ids = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
    for lo, hi in pieces(offsets):
        starts, stops, first = word_spans(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        if len(starts) < window:
            continue
        words = hash_spans(data[offsets[lo] : offsets[hi]], starts, stops)
        doc = np.repeat(np.arange(hi - lo), np.diff(first))
        whole = np.flatnonzero(doc[: len(words) - window + 1] == doc[window - 1 :])
        if not len(whole):
            continue
        name = _sliding_min(window_hashes(words, gram), window - gram + 1)[whole]
        yield ids[lo:hi], doc[whole], whole - first[doc[whole]], whole, name, words


def _names(batch: pa.RecordBatch, window: int, gram: int) -> Iterator[np.ndarray]:
    """The sketch entries of a batch: each name once for each document."""
    for _, doc, _, _, name, _ in _windows(batch, window, gram):
        order = np.lexsort((name, doc))
        name, doc = name[order], doc[order]
        once = np.ones(len(name), dtype=bool)
        once[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
        yield name[once]


def _texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    """k (the id), h (a hash of the text) and t."""
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NULL)).alias("k"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t"))


def covered_places(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """k, h and `places`: the first words of each document's windows that also start in a document with a smaller key."""
    spark = docs.sparkSession
    texts = _texts(docs, text, key)
    bits = sketch_bits(NAMES_PER_DOCUMENT * docs.count())
    often = spark.sparkContext.broadcast(repeated_bits(texts, lambda batch: _names(batch, window, gram), bits))

    def estimated(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """Document, first word and both hashes of the windows estimated repeated."""
        rows = often.value
        for ids, doc, place, at, name, words in _windows(batch, window, gram):
            keep = maybe_repeated(rows, name)
            if keep.any():
                at = at[keep]
                a = window_hashes(words, window)[at].view(np.int64)
                b = (window_hashes(mixed(words ^ _OTHER), window)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield ids[doc[keep]], place[keep].astype(np.int32), a, b

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(estimated(batch))
            if not found:
                continue
            ids, a, b = (np.concatenate([x[i] for x in found]) for i in (0, 2, 3))
            ids = ids[:, 0]
            order = np.lexsort((ids, b, a))
            ids, a, b = ids[order], a[order], b[order]
            new = np.ones(len(a), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(a)) - 1
            for i in range(0, len(first), 100_000):
                f, z = first[i : i + 100_000], last[i : i + 100_000]
                yield pa.record_batch([pa.array(x) for x in (a[f], b[f], ids[f], ids[z])], names=["a", "b", "least", "most"])

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, place, a, b in estimated(batch):
                yield pa.record_batch([pa.array(x) for x in (a, b, ids[:, 0].copy(), ids[:, 1].copy(), place)], names=["a", "b", "k", "h", "place"])

    with Scratch(spark) as scratch:
        # kept as a table, so that the join below has plain exchanges on both sides and skewed windows can be split
        repeats = scratch.keep(texts.mapInArrow(ends, "a long, b int, least long, most long").groupBy("a", "b").agg(F.min("least").alias("least"), F.max("most").alias("most")).filter("least < most").select("a", "b", "least"))
        later = texts.mapInArrow(occurrences, "a long, b int, k long, h long, place int").join(repeats, ["a", "b"]).filter("k > least")
        # a set: however often a row repeats, its places are no more than its text has
        return checkpointed(later.groupBy("k", "h").agg(F.collect_set("place").alias("places")))


def _joined(text: bytes) -> str:
    """The words of a text joined by one space: bytes split at the same characters as words here do."""
    return b" ".join(text.split()).decode()


def _cleaned(batch: pa.RecordBatch, lists: pa.Array | None, window: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Words counted and kept, for rows (key, name, text) and the places to remove."""
    data, offsets = text_bytes(batch.column(2))
    for lo, hi in pieces(offsets):
        body, inner = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, stops, first = word_spans(body, inner)
        raw, counts, gone, kept = body.tobytes(), [], [], []
        for i in range(hi - lo):
            if lists is None:
                whole = raw[inner[i] : inner[i + 1]]
                counts.append(int(first[i + 1] - first[i]))
                gone.append(0)
                kept.append(_joined(whole))
                continue
            s, e = starts[first[i] : first[i + 1]].tolist(), stops[first[i] : first[i + 1]].tolist()
            words = [raw[a:b] for a, b in zip(s, e)]
            if lists[lo + i].is_valid:
                at = lists[lo + i].values.to_numpy()
                change = np.zeros(len(s) + 1, dtype=np.int32)
                np.add.at(change, at, 1)
                np.add.at(change, np.minimum(at + window, len(s)), -1)
                words = [words[j] for j in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
            counts.append(len(s))
            gone.append(len(s) - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=names)


def dedup_substrings(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """key, n_words, n_removed and kept_text (the kept words joined by one space) for each row of docs.

    Only texts that lose words are moved to meet their places; a sketch of their keys tells them apart.
    """
    places = covered_places(docs, text, key, window).select(F.col("k").alias("_k"), F.col("h").alias("_h"), "places")
    # the key is carried as it is; _n names a row's document in the sketch
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(key).cast("long"), F.lit(_NULL)).alias("_k"), F.xxhash64(F.col(text)).alias("_h"), F.col(text).alias("_t"))
    rows = rows.select("_id", F.xxhash64("_k", "_h").alias("_n"), "_t", "_k", "_h")
    hit = docs.sparkSession.sparkContext.broadcast(members(places.select(F.xxhash64("_k", "_h"))))
    kind = docs.schema[key].dataType.simpleString()
    names, schema = ["_id", "n_words", "n_removed", "kept_text"], f"_id {kind}, n_words long, n_removed long, kept_text string"

    def flags(batch: pa.RecordBatch) -> np.ndarray:
        return maybe_member(hit.value, batch.column(1).to_numpy())

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _cleaned(batch.filter(pa.array(~flags(batch))), None, window, names)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(flags(batch)))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _cleaned(batch, batch.column(3), window, names)

    moved = rows.mapInArrow(touched, f"_id {kind}, _n long, _t string, _k long, _h long")
    moved = moved.join(places, ["_k", "_h"], "left").select("_id", "_n", "_t", "places")
    return rows.select("_id", "_n", "_t").mapInArrow(untouched, schema).unionByName(moved.mapInArrow(clean, schema)).withColumnRenamed("_id", key)
