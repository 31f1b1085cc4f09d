"""Language identification with error-correcting output codes.

Each language has a codeword of bits; for every bit a binary classifier over hashed byte n-grams (one
to four bytes, A-Z as a-z) predicts its value, as the mean of a text's n-gram weights.  A text's
language is the one whose codeword has the least loss summed over bits, weighted by how well each
bit was told in training; a text is ambiguous if the second least loss is within MARGIN of the least.

The weights are log odds of n-gram counts over a bounded sample (SAMPLE texts per language, the
least by a seeded hash of the id, of labelled texts outside the held-out third); the size of the
model is fixed.  Prediction reads whole texts only, never a label, source or id.

Cases: null texts and texts without a letter (Unicode L*; not digits or fractions) get `und` and score 0; with no labelled text
everything is `und`; a null language is no label; a very long text is read in pieces of 256 kB; of losses that tie the language first by
name is taken (and the text is ambiguous); repeated rows fare alike; an empty table gives an
empty result; other columns are carried, those named like a result are replaced (see `names`).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytehash import pieces, text_bytes, tidied
from .common import held_out

UNKNOWN = "und"
#: Training texts per language, and bytes of n-gram space.
SAMPLE = 1500
LOG_FEATURES = 16
ORDERS = (1, 2, 3, 4)
#: Bits of a codeword per bit that tells the languages apart.
REDUNDANCY = 5
MARGIN = 0.05
SEED = 41

#: What may be a letter, to find the first quickly; str.isalpha decides (numbers like ½ are not letters).
_WORDY = re.compile(r"[^\W\d_]")
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_SPACES = [0x20, *range(0x09, 0x0E)]
_LOWER[_SPACES] = 32
_LOWER[48:58] = 48  # digits are alike
_MIX = np.uint32(0x9E3779B1)


def has_letter(text: str) -> bool:
    """Whether any character is of a Unicode category L*."""
    return any(m[0].isalpha() for m in _WORDY.finditer(text))


def features(body: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashed n-gram that starts at each byte) of lower-cased bytes."""
    x = _LOWER[body]
    code = np.zeros(len(x), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if n > len(x):
            return
        code = (code[: len(x) - n + 1] << np.uint32(8)) | x[n - 1 :]
        if n in ORDERS:
            yield n, ((code + np.uint32(n)) * _MIX) >> np.uint32(32 - LOG_FEATURES)


def codewords(n: int, seed: int = SEED) -> np.ndarray:
    """n codewords of -1 and 1, chosen among random matrices for the largest least distance of rows; no column is constant or the same as or opposite to another, if that can be."""
    if n < 2:
        return np.ones((n, 1))
    bits = max(2 ** (n - 1) - 1, 1) if n <= 4 else math.ceil(REDUNDANCY * math.log2(n))
    if n <= 4:  # every way to part so few languages
        return np.array([[1 if i == 0 or not (b >> (i - 1)) & 1 else -1 for b in range(1, 2 ** (n - 1))] for i in range(n)], dtype=float)
    rng, best, far = np.random.Generator(np.random.PCG64(seed)), None, -1
    for _ in range(2000):
        m = np.where(rng.random((n, bits)) < 0.5, -1.0, 1.0)
        distance = (bits - m @ m.T) / 2
        least = distance[np.triu_indices(n, 1)].min()
        if least > far and (abs(m.sum(0)) < n).all():
            best, far = m, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits, of log odds
    scale: np.ndarray  # per bit: turns a mean weight into a margin
    trust: np.ndarray  # per bit: weight of its loss

    def margins(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return sums / np.maximum(counts, 1)[:, None] * self.scale

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted loss of each text for each language."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None])
        return (loss * self.trust).sum(-1) / self.trust.sum()


def _sums(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed weights of the n-grams inside each text, and their number."""
    n = len(offsets) - 1
    sums, counts = np.zeros((n, weights.shape[1])), np.zeros(n)
    step = 1 << 18
    for i in range(n):
        a, b = int(offsets[i]), int(offsets[i + 1])
        for at in range(a, b, step):
            body = data[at : min(b, at + step + max(ORDERS) - 1)]
            own = min(b, at + step) - at
            for size, grams in features(body):
                some = grams[: min(own, len(grams))]
                sums[i] += np.bincount(some, minlength=1 << LOG_FEATURES) @ weights if len(some) > 1 << LOG_FEATURES else weights[some].sum(0)
                counts[i] += len(some)
    return sums, counts


def train(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """A model from labelled texts whose key isn't held out."""
    known = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(key)))
    # two passes over ids and labels: where each language's sample ends by hash, then the texts below
    order = F.xxhash64(key, F.lit(SEED))
    known = known.select(F.col(label).cast("string").alias("lang"), F.col(text).alias("text"), order.alias("order"))
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return None
    languages = sorted(totals)
    # hashes are uniform: about twice the sample passes the cut, the rest is settled exactly below
    cut = F.lit(None).cast("long")
    for lang in languages:
        part = min(1.0, 2.0 * sample / totals[lang])
        cut = F.when(F.col("lang") == lang, F.lit(min(2**63 - 1, int(-(2**63) + part * 2**64)))).otherwise(cut)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "text"))
    some = known.filter(F.col("order") <= cut).withColumn("rank", rank).filter(F.col("rank") <= sample).select("lang", "order", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """N-gram counts of each language in even and odd texts, each text counting the same."""
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, (lang, order) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("order").to_pylist())):
                grams = [g for _, g in features(data[offsets[i] : offsets[i + 1]])]
                if grams:
                    c = np.bincount(np.concatenate(grams), minlength=1 << LOG_FEATURES).astype(np.float32)
                    key = (lang, order & 1)
                    sums[key] = sums.get(key, 0) + c * np.float32(1000 / c.sum())
        for (lang, half), c in sums.items():
            yield pa.record_batch([pa.array([lang]), pa.array([half], pa.int32()), pa.array([c.astype(np.float32).tobytes()], pa.binary())], names=["lang", "half", "counts"])

    counts = np.zeros((len(languages), 2, 1 << LOG_FEATURES))
    for r in sorted(some.mapInArrow(tidied(count), "lang string, half int, counts binary").collect(), key=lambda r: (r["lang"], r["half"], r["counts"])):
        counts[languages.index(r["lang"]), r["half"]] += np.frombuffer(r["counts"], dtype=np.float32)
    code = codewords(len(languages))

    def log_odds(c: np.ndarray) -> np.ndarray:
        """Features x bits."""
        p = c / np.maximum(c.sum(1, keepdims=True), 1)
        ones, zeros = (code > 0).astype(float), (code < 0).astype(float)
        a = p.T @ (ones / np.maximum(ones.sum(0), 1)) + 1e-6
        b = p.T @ (zeros / np.maximum(zeros.sum(0), 1)) + 1e-6
        return np.log(a / b)

    # the scale and trust of each bit come from halves that judge each other
    spread, right = np.zeros(code.shape[1]), np.zeros(code.shape[1])
    for half in (0, 1):
        own, other = counts[:, half], counts[:, 1 - half]
        m = (other / np.maximum(other.sum(1, keepdims=True), 1)) @ log_odds(own) * code
        spread += np.abs(m).mean(0) / 2
        right += (m > 0).mean(0) / 2
    whole = log_odds(counts.sum(1))
    return Model(languages, code, whole.astype(np.float32), 4.0 / np.maximum(spread, 1e-6), np.maximum(right - 0.5, 0.05))


def identify(docs: DataFrame, model: Model | None, text: str = "text", margin: float = MARGIN, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """docs with the language, a score (0 to 1) and whether it is ambiguous, named by `names`; columns of docs with these names are replaced."""
    # plain values: a broadcast names classes, which executors may not have
    held = docs.sparkSession.sparkContext.broadcast(vars(model) if model else None)
    plain = docs.select(*[c for c in docs.columns if c not in names])
    at = plain.columns.index(text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**held.value) if held.value else None
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            langs, scores, unclear = [], [], []
            for lo, hi in pieces(offsets):
                raw = data[offsets[lo] : offsets[hi]].tobytes()
                inner = offsets[lo : hi + 1] - offsets[lo]
                lettered = [has_letter(raw[inner[i] : inner[i + 1]].decode("utf-8", "replace")) for i in range(hi - lo)]
                if model is None:
                    losses = None
                else:
                    losses = model.losses(model.margins(*_sums(data[offsets[lo] : offsets[hi]], inner, model.weights)))
                for i, some in enumerate(lettered):
                    if not some or losses is None:
                        langs.append(UNKNOWN), scores.append(0.0), unclear.append(True)
                        continue
                    loss = losses[i]
                    best = int(loss.argmin())
                    odds = np.exp(-(loss - loss[best]) * model.code.shape[1])
                    rest = np.delete(loss, best)
                    langs.append(model.languages[best])
                    scores.append(float(odds[best] / odds.sum()))
                    unclear.append(bool(len(rest) and rest.min() - loss[best] < margin))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unclear, pa.bool_())], names=[*batch.schema.names, *names])

    return plain.mapInArrow(tidied(predict), f"{fields}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean")
