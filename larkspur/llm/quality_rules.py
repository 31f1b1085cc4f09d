"""Quality rules and an isolation forest on their statistics.

Statistics of whole texts are counted on bytes with numpy (statistics()).  An isolation forest cuts
random subsamples by random splits of how far ratios of these statistics leave their ordinary range (Excess); texts that
few cuts isolate are anomalous.  The forest needs no labels: it is fitted on SAMPLE rows of all that pass the base rules,
the least by a seeded hash.  The ordinary range is that of all but a few labelled good rows (SAMPLE of them at
most), or, where none is labelled, the middle half of the sample.  The threshold on the score comes from all labelled
rows but those held out (held_out(), about a third of the ids, left for judging it), as counts by score: the one that finds
most bad documents while it loses at most MAX_LOSS of the good ones.  Without labelled rows of both kinds it is DEFAULT_THRESHOLD.

Cases: a null or empty text has all counts 0 (and so fails the base rules); null labels are none;
a document labelled more than once counts each time; a very long text is one Arrow row, hashed in pieces; scores that
tie with the threshold are dropped; repeated rows are judged alike; an empty
table gives an empty result; other columns of docs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import hash_spans, pieces, text_bytes, window_hashes, word_spans
from .common import checkpointed, held_out, least_by_hash

#: Fixed values of the rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
REPEAT = 3

#: Rows the forest is fitted on; rows and number of its trees (small ones, so that alike anomalies do not hide each other); what part of good documents the threshold may lose.
SAMPLE = 8192
TREE_ROWS = 32
TREES = 200
MAX_LOSS = 0.005
#: Part of rows beyond each end of a ratio's ordinary range: of labelled good ones; of any, where none is labelled.
TAIL, WIDE_TAIL = 0.001, 0.25
DEFAULT_THRESHOLD = 0.65
SEED = 29

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_distinct"]
_SPACES = b" \t\n\x0b\x0c\r"


def _class(members: bytes | range) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


_KINDS = {
    "word_chars": ~_class(_SPACES) & ~_class(range(0x80, 0xC0)),
    "n_symbols": _class(SYMBOLS),
    "n_upper": _class(range(65, 91)),
    "n_letters": _class([*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]),
    "n_digits": _class(range(48, 58)),
    "n_marks": _class(b"!?.,;:"),
}


def _batch_statistics(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    data, offsets = text_bytes(batch.column(1))
    for lo, hi in pieces(offsets):
        body, inner = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        n = hi - lo
        starts, stops, first = word_spans(body, inner)
        words = hash_spans(body, starts, stops)
        grams = window_hashes(words, REPEAT)
        out = {c: np.zeros(n, dtype=np.int64) for c in COUNTS}
        out["n_words"] = np.diff(first).astype(np.int64)
        for name, kind in _KINDS.items():
            upto = np.concatenate([[0], np.cumsum(kind[body], dtype=np.int64)])
            out[name] = np.diff(upto[inner])
        raw = body.tobytes()
        for i in range(n):
            a, b = int(first[i]), int(first[i + 1])
            if b == a:
                continue
            out["n_distinct"][i] = len(np.unique(words[a:b]))
            if b - a >= REPEAT:
                _, which, times = np.unique(grams[a : b - REPEAT + 1], return_inverse=True, return_counts=True)
                twice = times[which] > 1
                if twice.any():
                    covered = np.zeros(b - a, dtype=bool)
                    for j in range(REPEAT):
                        covered[j : j + len(twice)] |= twice
                    out["n_repeat_words"][i] = covered.sum()
            lines = [x for x in raw[inner[i] : inner[i + 1]].split(b"\n") if x.strip(_SPACES)]
            out["n_lines"][i] = len(lines)
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n)] + [pa.array(out[c]) for c in COUNTS], names=["k", *COUNTS])


def statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and COUNTS for each row of docs."""
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batch_statistics(batch)

    return docs.select(F.col(key).alias("k"), F.col(text)).mapInArrow(count, f"k {kind}, " + ", ".join(f"{c} long" for c in COUNTS)).withColumnRenamed("k", key)


def ratios(counts: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest sees of COUNTS."""
    c = {k: np.asarray(v, dtype=np.float64) for k, v in counts.items()}
    words, chars, lines, letters = (np.maximum(c[k], 1.0) for k in ("n_words", "word_chars", "n_lines", "n_letters"))
    return np.column_stack([
        c["word_chars"] / words,
        c["n_symbols"] / words,
        c["n_dup_lines"] / lines,
        c["n_repeat_words"] / words,
        c["n_upper"] / letters,
        c["n_digits"] / chars,
        c["n_marks"] / words,
        np.log(np.maximum(c["n_distinct"], 1.0)) / np.log(np.maximum(c["n_words"], 2.0)),
    ])


def _ratios_of(rows: DataFrame) -> np.ndarray:
    """Ratios of a bounded sample of rows, on the driver."""
    got = rows.select(*COUNTS).toPandas()
    return ratios({c: got[c].to_numpy() for c in COUNTS})


class Excess:
    """How far each ratio lies outside the range of all but a part `tail` of ordinary rows at each end, from 0 (inside) towards 1.

    Ordinary rows become equal, so that the forest isolates what breaks a rule and not what is merely
    at the edge of the ordinary.
    """

    def __init__(self, ordinary: np.ndarray, tail: float = TAIL):
        self.low, self.high = np.quantile(ordinary, [tail, 1 - tail], axis=0)
        self.unit = np.maximum(ordinary.std(axis=0), 1e-9)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        x = (np.maximum(rows - self.high, 0) + np.maximum(self.low - rows, 0)) / self.unit
        return x / (1 + x)


def _expected_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees as arrays: split feature (-1: leaf), split value, left child (right: the next), path length of leaves."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.norm = float(_expected_path(np.array(min(tree_rows, max(len(rows), 2)))))
        self.trees = [self._grow(rows[rng.permutation(len(rows))[:tree_rows]], rng, int(np.ceil(np.log2(tree_rows)))) for _ in range(trees)]

    @staticmethod
    def _grow(rows: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[np.ndarray, ...]:
        feature, value, child, path = [-1], [0.0], [0], [0.0]
        todo = [(0, rows, 0)]
        while todo:
            node, own, depth = todo.pop()
            low, high = (own.min(0), own.max(0)) if len(own) else (np.zeros(1), np.zeros(1))
            wide = np.flatnonzero(high > low)
            if depth >= limit or len(own) < 2 or not len(wide):
                path[node] = depth + float(_expected_path(np.array(len(own))))
                continue
            f = int(rng.choice(wide))
            at = float(rng.uniform(low[f], high[f]))
            feature[node], value[node], child[node] = f, at, len(feature)
            for part in (own[own[:, f] < at], own[own[:, f] >= at]):
                todo.append((len(feature), part, depth + 1))
                for column, x in ((feature, -1), (value, 0.0), (child, 0), (path, 0.0)):
                    column.append(x)
        return np.array(feature), np.array(value), np.array(child), np.array(path)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1; higher is more anomalous."""
        total = np.zeros(len(rows))
        for feature, value, child, path in self.trees:
            node = np.zeros(len(rows), dtype=np.int64)
            while True:
                f = feature[node]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                at = node[inner]
                node[inner] = child[at] + (rows[inner, f[inner]] >= value[at])
            total += path[node]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE, max_loss: float = MAX_LOSS) -> DataFrame:
    """key, COUNTS, base_failed, anomaly (the forest's score), threshold and kept for each row of docs."""
    counts = statistics(docs, text, key)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    counts = checkpointed(counts.withColumn("base_failed", failed))
    marks = labels.filter(F.col(label).isNotNull()).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_label")).filter(~held_out(F.col("_k")))
    passing = counts.filter("NOT base_failed").withColumn("_o", F.xxhash64(key, *COUNTS, F.lit(SEED)))
    some = _ratios_of(least_by_hash(passing, "_o", sample, *COUNTS))
    good = _ratios_of(least_by_hash(passing.join(marks.filter("_label = 1"), passing[key] == marks["_k"]), "_o", sample, *COUNTS))
    view = forest = None
    if len(some):
        view = Excess(good) if len(good) else Excess(some, WIDE_TAIL)
        forest = IsolationForest(view(some))

    kind = docs.schema[key].dataType.simpleString()
    columns = [key, *COUNTS, "base_failed"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = forest.scores(view(ratios({c: batch.column(c).to_numpy() for c in COUNTS}))) if forest else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, "anomaly"])

    scored = counts.select(*columns).mapInArrow(score, f"{key} {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double")
    known = scored.filter("NOT base_failed").join(marks, scored[key] == marks["_k"])
    seen = known.groupBy(F.floor(F.col("anomaly") * 2000).cast("int").alias("step"), "_label").agg(F.count(F.lit(1)).alias("n")).collect()
    threshold = choose_threshold([(r["step"], r["_label"], r["n"]) for r in seen], max_loss)
    return scored.withColumn("threshold", F.lit(threshold)).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.col("threshold")))


def choose_threshold(seen: list[tuple[int, int, int]], max_loss: float, steps: int = 2000) -> float:
    """The lowest score, in steps, at and above which at most max_loss of the good rows lie."""
    good, bad = np.zeros(steps + 1), np.zeros(steps + 1)
    for step, label, n in seen:
        (good if label == 1 else bad)[min(max(step, 0), steps)] += n
    if not good.sum() or not bad.sum():
        return DEFAULT_THRESHOLD
    lost = np.cumsum(good[::-1])[::-1] / good.sum()
    found = np.cumsum(bad[::-1])[::-1] / bad.sum()
    fit = np.flatnonzero(lost <= max_loss)
    if not len(fit):
        return 1.01
    best = fit[found[fit] >= found[fit].max()]
    return float(best[-1] / steps)
