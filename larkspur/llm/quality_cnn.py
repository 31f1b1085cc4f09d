"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.  Each byte is embedded; FILTERS
learned filters over WIDTH bytes slide over a chunk by STRIDE bytes; each filter keeps its largest
response in the chunk.  The mean and the maximum over the chunks feed one logistic unit, the probability
of label 1.

The filters are trained with Adam on at most SAMPLE texts a label (the least by a seeded hash of the
id, outside the held-out third) and at most POOL random chunks of each; scoring reads every
chunk of every text, in pieces.  A score depends on the text alone.

Cases: null and empty texts are one empty chunk and get a score like any other; null labels and null ids of labels are none; a
very long text is one Arrow row, scored in groups of chunks, and gives POOL chunks to training; with no label,
or one label only, the score is its share (0.5 if none); an id labelled both ways trains both; of rows that share a labelled id one
is trained on; score 0.5 is label 1; repeated rows fare alike; an empty table gives an empty result; other columns are carried, those
named like a result are replaced (see `names`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import pieces, text_bytes
from .common import held_out, least_by_hash

CHUNK, OVERLAP = 1024, 64
STEP = CHUNK - OVERLAP
WIDTH, STRIDE = 12, 4
EMBED, FILTERS = 8, 24
SAMPLE = 1200
#: Chunks of a text that reach the driver at most, and that one step of training sees.
POOL, TRAIN_CHUNKS = 8, 3
EPOCHS, BATCH, RATE = 14, 64, 0.01
SEED = 53
#: Chunks convolved at a time.
GROUP = 64


def chunks_of(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunks of a text, padded with zeros, and how many steps of each begin inside the text."""
    n = max(1, -(-(len(body) - OVERLAP) // STEP))
    padded = np.zeros(n * STEP + OVERLAP, dtype=np.uint8)
    padded[: len(body)] = body
    view = np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (STEP, 1))
    steps = (CHUNK - WIDTH) // STRIDE + 1
    return view, np.clip(-(-(len(body) - np.arange(n) * STEP) // STRIDE), 1, steps)


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = rng.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.base = np.zeros(1, dtype=np.float32)

    @classmethod
    def of(cls, parameters: list[np.ndarray]) -> Network:
        net = cls.__new__(cls)
        net.embed, net.filters, net.bias, net.out, net.base = parameters
        return net

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.base]

    def responses(self, chunks: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Each filter at each step of each chunk; 0 where it does not fire or begins after the text."""
        n, blocks, parts = len(chunks), CHUNK // STRIDE, WIDTH // STRIDE
        size = STRIDE * EMBED
        kernel = np.concatenate([self.filters[p * size : (p + 1) * size] for p in range(parts)], axis=1)
        made = (self.embed[chunks].reshape(n * blocks, size) @ kernel).reshape(n, blocks, parts * FILTERS)
        last = blocks - parts + 1
        y = made[:, :last, :FILTERS] + self.bias
        for p in range(1, parts):
            y += made[:, p : p + last, p * FILTERS : (p + 1) * FILTERS]
        np.maximum(y, 0, out=y)
        if (steps < last).any():
            y[np.arange(last)[None, :] >= steps[:, None]] = 0
        return y

    def pooled(self, chunks: np.ndarray, steps: np.ndarray) -> np.ndarray:
        return np.concatenate([self.responses(chunks[i : i + GROUP], steps[i : i + GROUP]).max(1) for i in range(0, len(chunks), GROUP)])

    def probability(self, mean: np.ndarray, most: np.ndarray) -> np.ndarray:
        z = np.concatenate([mean, most], axis=1) @ self.out + self.base
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of each text."""
        n = len(offsets) - 1
        mean, most = np.zeros((n, FILTERS), dtype=np.float32), np.zeros((n, FILTERS), dtype=np.float32)
        held: list[tuple[np.ndarray, np.ndarray, int]] = []

        def settle() -> None:
            if held:
                pool = self.pooled(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                who = np.repeat([h[2] for h in held], [len(h[1]) for h in held])
                np.add.at(mean, who, pool)
                np.maximum.at(most, who, pool)
                held.clear()

        count, size = np.zeros(n), 0
        for i in range(n):
            chunks, steps = chunks_of(data[offsets[i] : offsets[i + 1]])
            count[i] = len(chunks)
            for at in range(0, len(chunks), 4 * GROUP):
                part = chunks[at : at + 4 * GROUP]
                held.append((part, steps[at : at + 4 * GROUP], i))
                size += len(part)
                if size >= 4 * GROUP:
                    settle()
                    size = 0
        settle()
        return self.probability(mean / np.maximum(count, 1)[:, None].astype(np.float32), most)

    def gradients(self, chunks: np.ndarray, steps: np.ndarray, who: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss over texts; chunk i belongs to text who[i]."""
        n = len(labels)
        y = self.responses(chunks, steps)
        at = y.argmax(1)
        pool = np.take_along_axis(y, at[:, None, :], 1)[:, 0]
        count = np.bincount(who, minlength=n).astype(np.float32)[:, None]
        mean, most, ties = (np.zeros((n, FILTERS), dtype=pool.dtype) for _ in range(3))
        np.add.at(mean, who, pool)
        mean /= np.maximum(count, 1)
        np.maximum.at(most, who, pool)
        top = pool == most[who]
        np.add.at(ties, who, top)  # chunks overlap, so a text's maximum may be met twice
        error = ((self.probability(mean, most) - labels) / n).astype(pool.dtype)
        d_out = np.concatenate([mean, most], axis=1).T @ error
        d_pool = (error[:, None] * self.out[:FILTERS] / np.maximum(count, 1))[who] + error[who][:, None] * self.out[FILTERS:] * (top / np.maximum(ties, 1)[who])
        d_pool[pool <= 0] = 0
        d_embed, d_filters = np.zeros_like(self.embed), np.zeros_like(self.filters)
        rows, columns = np.nonzero(d_pool)
        g = d_pool[rows, columns]
        seen = chunks[rows[:, None], at[rows, columns][:, None] * STRIDE + np.arange(WIDTH)]
        weighted = (self.embed[seen] * g[:, None, None]).reshape(len(g), -1)
        np.add.at(d_filters.T, columns, weighted)
        back = (self.filters.T[columns] * g[:, None]).reshape(len(g), WIDTH, EMBED)
        np.add.at(d_embed, seen, back)
        d_embed[0] = 0
        return [d_embed, d_filters, d_pool.sum(0), d_out, np.array([error.sum()], dtype=pool.dtype)]


Chunks = tuple[np.ndarray, np.ndarray]


def fit(cut: list[Chunks], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Train a network on each text's chunks and steps; rarer labels are drawn as often as others."""
    rng = np.random.Generator(np.random.PCG64(seed))
    net = Network(seed)
    net.embed[0] = 0
    sides = [np.flatnonzero(labels == v) for v in (0, 1)]
    half = max(len(s) for s in sides)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    turn, total = 0, epochs * -(-2 * half // BATCH)
    for _ in range(epochs):
        order = rng.permutation(np.concatenate([np.resize(rng.permutation(s), half) for s in sides]))
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            picks = [rng.choice(len(cut[i][0]), min(TRAIN_CHUNKS, len(cut[i][0])), replace=False) for i in some]
            chunks = np.concatenate([cut[i][0][p] for i, p in zip(some, picks)])
            steps = np.concatenate([cut[i][1][p] for i, p in zip(some, picks)])
            grads = net.gradients(chunks, steps, np.repeat(np.arange(len(some)), [len(p) for p in picks]), labels[some])
            turn += 1
            rate = RATE * 0.5 * (1 + np.cos(np.pi * turn / total))
            for p, g, (m, v) in zip(net.parameters(), grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    return net


def some_chunks(body: np.ndarray, most: int, seed: int) -> Chunks:
    """At most `most` chunks of a text, drawn by the seed and the text's length."""
    chunks, steps = chunks_of(body)
    if len(chunks) <= most:
        return chunks, steps
    at = np.sort(np.random.Generator(np.random.PCG64([seed, len(body)])).choice(len(chunks), most, replace=False))
    return chunks[at], steps[at]


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Network | float:
    """A network, or the share of label 1 where there is nothing to tell apart.

    The driver gets POOL chunks of each chosen text at most, cut where the text is read.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_label"))
    known = known.distinct().withColumn("_o", F.xxhash64("_k", F.lit(SEED)))
    sides = [least_by_hash(known.filter(F.col("_label") == v), "_o", sample, "_k") for v in (0, 1)]
    chosen = sides[0].union(sides[1]).select("_k", "_label")  # 2 * sample rows at most, so it may be broadcast
    rows = docs.select(F.col(key), F.col(text)).join(F.broadcast(chosen), F.col(key) == F.col("_k")).select(F.xxhash64("_k").alias("o"), "_label", F.col(text).alias("t"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for i in range(batch.num_rows):
                chunks, steps = some_chunks(data[offsets[i] : offsets[i + 1]], POOL, SEED)
                yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(i, 1) for j in (0, 1)), pa.array([chunks.tobytes()], pa.binary()), pa.array([steps.astype(np.int64).tobytes()], pa.binary())], names=["o", "_label", "c", "s"])

    # one row an id and label, however often its row repeats
    made = rows.mapInArrow(cut, "o long, _label int, c binary, s binary").groupBy("o", "_label").agg(F.min(F.struct("c", "s")).alias("m")).collect()
    made.sort(key=lambda r: (r["o"], r["_label"]))
    marks = np.array([r["_label"] for r in made], dtype=np.float32)
    if not len(made) or marks.min() == marks.max():
        return float(marks.mean()) if len(made) else 0.5
    return fit([(np.frombuffer(r["m"]["c"], dtype=np.uint8).reshape(-1, CHUNK), np.frombuffer(r["m"]["s"], dtype=np.int64)) for r in made], marks)


def scored(docs: DataFrame, model: Network | float, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with a score (0 to 1) and its verdict (0 or 1), named by `names`; columns of docs with these names are replaced."""
    plain = docs.select(*[c for c in docs.columns if c not in names])
    at = plain.columns.index(text)
    # plain values: a broadcast names classes, which executors may not have
    held = docs.sparkSession.sparkContext.broadcast(model if isinstance(model, float) else model.parameters())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value if isinstance(held.value, float) else Network.of(held.value)
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            out = np.full(batch.num_rows, model, dtype=np.float64) if isinstance(model, float) else np.zeros(batch.num_rows)
            if not isinstance(model, float):
                for lo, hi in pieces(offsets):
                    out[lo:hi] = model.score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=[*batch.schema.names, *names])

    return plain.mapInArrow(score, f"{fields}, `{names[0]}` double, `{names[1]}` int")
