"""Pack documents into sequences of a fixed number of tokens, as few as can be found.

Documents longer than a sequence are cut so that all pieces but the first are whole sequences.  What remains
is bin packing, and only the lengths of pieces matter: their histogram has at most CAPACITY rows,
whatever the input, and is solved on the driver by bin completion.  Best fit gives the first
incumbent.  The search then takes the largest piece left and enumerates all undominated fillings
around it whose waste a better packing can bear, those of least waste among the next LOOK first.  A filling is
applied as often as the histogram allows, and, on the way back, once; a branch is cut by its waste, by a lower
bound on what is left, or if its rest was reached before with no more bins.  No filling is left out, so the
search ends with a packing of the fewest bins (effort=None), or when the incumbent meets the lower bound, or
after EFFORT sets of pieces with the best packing so far.  The solution is a list of patterns with multiplicities;
pieces are dealt to its slots by their number among pieces of the same length, which is counted in parallel.

Cases: a null or empty text is one piece that holds the end token only; a very long text is one Arrow row, so
its ids and pieces are in a worker's memory at once (some 10 bytes a byte); texts that the fast engine gives
up on (white space of a million characters) go through the library; pieces of equal length take places by id, and
rows of one id by piece and checksum (which of two equal pieces goes where is not told apart by any output); repeated rows are packed each;
an empty table gives an empty result; other columns of docs are not read.
"""

from __future__ import annotations

import json
import re
import sys
import types
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import tidied
from .common import checkpointed, numbered

CAPACITY = 1024
TOKENIZER = "byte_bpe_50k.json"
END = 2
#: Sets of pieces the search looks at in all; sets of a node met before the best of them is tried; states remembered.
EFFORT, LOOK, SEEN = 400_000, 40, 100_000

Pattern = tuple[tuple[int, ...], int]


# --- tokens


def _load(path: str | None):
    """encode(text) -> array of ids, for the tokenizer file at path; kept for the life of the worker."""
    held = sys.modules.setdefault("_larkspur_worker", types.ModuleType("_larkspur_worker")).__dict__.setdefault("tokenizers", {})
    if path not in held:
        import tiktoken
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            file = public_tokenizers.path(TOKENIZER)
        else:
            file = path
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        special = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        fast = None
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        first = len(vocab) - len(merges)
        if spec.get("normalizer") is None and spec.get("pre_tokenizer") == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and all(vocab.get(a + b) == first + i for i, (a, b) in enumerate(merges)):
            # merges come in the order of ids, so a rank-based engine makes the same ids, faster
            from public_tokenizers import PATTERN

            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
            fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in vocab.items()}, special_tokens={})
        unusual = re.compile("|".join(special)) if special else None
        exact: list = []  # loaded for the first text that needs it

        def by_library(text: str) -> np.ndarray:
            if not exact:
                exact.append(Tokenizer.from_file(file))
            return np.array(exact[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

        def encode(text: str) -> np.ndarray:
            if fast is None or unusual and unusual.search(text):
                return by_library(text)
            try:
                return fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)
            except ValueError:  # its pattern gives up on white space of some 10^6 characters on end
                return by_library(text)

        held[path] = encode
    return held[path]


def pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None) -> DataFrame:
    """key, piece, start, length and ids (little-endian unsigned 32-bit numbers) of each piece of each row.

    tokenizer: the file; None takes the public one of that name, wherever it is installed on a worker.
    """
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _load(tokenizer)
        for batch in batches:
            size = 0
            rows: list[list] = [[], [], [], [], []]
            for i in range(batch.num_rows):
                ids = np.append(encode(batch.column(1)[i].as_py() or ""), np.uint32(end)).astype("<u4")
                n = -(-len(ids) // capacity)
                head = len(ids) - (n - 1) * capacity
                for p in range(n):
                    a, b = (0, head) if p == 0 else (head + (p - 1) * capacity, head + p * capacity)
                    for column, x in zip(rows, (i, p, a, b - a, ids[a:b].tobytes())):
                        column.append(x)
                size += len(ids)
                if size > 1_000_000 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0])), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.binary())], names=[key, "piece", "start", "length", "ids"])
                    rows, size = [[], [], [], [], []], 0

    return docs.select(key, text).mapInArrow(tidied(cut), f"`{key}` {kind}, piece int, start long, length long, ids binary")


# --- bin packing of a histogram


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: total size, and pieces that exclude each other for every threshold."""
    size = np.array(sorted(counts), dtype=np.int64)
    many = np.array([counts[int(k)] for k in size], dtype=np.int64)
    bytes_ = np.concatenate([[0], np.cumsum(size * many)])
    pieces_ = np.concatenate([[0], np.cumsum(many)])
    half = int(np.searchsorted(size, capacity // 2, side="right"))  # pieces from here on are over half a bin
    t = np.concatenate([[0], size[:half]])
    low = np.concatenate([[0], np.arange(half)])  # pieces of at least t
    top = np.searchsorted(size, capacity - t, side="right")  # pieces from here on exclude all of at least t
    small = bytes_[half] - bytes_[low]
    room = capacity * (pieces_[top] - pieces_[half]) - (bytes_[top] - bytes_[half])
    bins = pieces_[-1] - pieces_[half] + np.maximum(0, -(-(small - room) // capacity))
    return max(int(-(-bytes_[-1] // capacity)), int(bins.max()))


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit by decreasing length; bins that look alike are handled together."""
    groups: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if not groups[room]:
            insort(rooms, room)
        groups[room][pattern] = groups[room].get(pattern, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                whole, rest = divmod(left, each)
                if whole:
                    put(capacity - each * length, (length,) * each, whole)
                if rest:
                    put(capacity - rest * length, (length,) * rest, 1)
                break
            room = rooms[at]
            pattern, n = groups[room].popitem()
            used = min(n, left)
            if n > used:
                groups[room][pattern] = n - used
            if not groups[room]:
                rooms.pop(at)
            put(room - length, (*pattern, length), used)
            left -= used
    return [(p, n) for room in groups for p, n in groups[room].items()]


def fillings(room: int, counts: dict[int, int], lengths: list[int], waste: int, effort: list[float]) -> Iterator[tuple[int, ...]]:
    """Undominated sets of pieces of at most `room`, at least room - waste.

    A set is dominated if one of its pieces, or two, can be replaced by one larger piece that is left.  Takes 1 off
    effort[0] for each set looked at, and raises StopSearch below 0.
    """
    if room in counts:  # one piece fills it: every other set is dominated
        yield (room,)
        return

    def dominated(some: tuple[int, ...], slack: int) -> bool:
        sums = {x for x in some} | {a + b for i, a in enumerate(some) for b in some[i + 1 :]}
        for s in sums:
            at = bisect_left(lengths, s)
            while at < len(lengths) and lengths[at] <= s + slack:
                x = lengths[at]
                if x not in some and (x > s or s not in some):
                    return True
                at += 1
        return False

    if not lengths or lengths[0] > room:
        if room <= waste:
            yield ()
        return
    # depth first with a stack of its own: pieces so far, room left, next place in lengths, whether any piece fits
    stack: list[list] = [[(), room, bisect_left(lengths, room + 1) - 1, False]]
    while stack:
        some, left, at, fits = top = stack[-1]
        if at >= 0:
            top[2] -= 1
            x = lengths[at]
            if some.count(x) < counts[x]:
                top[3] = True
                effort[0] -= 1
                if effort[0] < 0:
                    raise StopSearch
                stack.append([(*some, x), left - x, bisect_left(lengths, min(left - x, x) + 1) - 1, False])
            continue
        stack.pop()
        if not fits and left <= waste and some and not dominated(some, left):
            yield some


class StopSearch(Exception):
    """The effort allowed is spent."""


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY, effort: float | None = EFFORT, look: int = LOOK) -> list[Pattern]:
    """Patterns of lengths and how often each is used; every piece is in one.

    effort: sets of pieces looked at in all, at most; None searches until the packing is proved to have the
    fewest bins.  look: sets of a node that are met before the best of them is tried; it decides the order alone.
    """
    counts = {k: v for k, v in counts.items() if v > 0}
    if not counts:
        return []
    if max(counts) > capacity or min(counts) < 1:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    best = best_fit(counts, capacity)
    bins = sum(n for _, n in best)
    goal = lower_bound(counts, capacity)
    total = sum(k * v for k, v in counts.items())
    left_effort = [float("inf") if effort is None else float(effort)]
    seen: dict[tuple, int] = {}  # what is left -> fewest bins it was reached with

    def branches(left: dict[int, int], used: int, size: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """Fillings around the largest piece with how often each is applied: as often as the counts allow, or once."""
        largest = max(left)
        rest = dict(left)
        rest[largest] -= 1
        if not rest[largest]:
            del rest[largest]

        def spare() -> int:  # waste that a better packing can still have
            return (bins - 1) * capacity - size - used * capacity

        if spare() < 0:
            return
        some = fillings(capacity - largest, rest, sorted(rest), spare(), left_effort)
        while True:
            batch = []
            for filling in some:
                batch.append(filling)
                if len(batch) == look or sum(filling) == capacity - largest:
                    break
            if not batch:
                return
            batch.sort(key=lambda f: -sum(f))
            for filling in batch:
                pattern = (largest, *filling)
                times = min(left[x] // pattern.count(x) for x in set(pattern))
                for t in (times, 1) if times > 1 else (1,):
                    if capacity - sum(pattern) <= spare():
                        yield pattern, t

    stack = [(counts, [], 0, total, branches(counts, 0, total))]
    try:
        while stack and bins > goal:
            left, patterns, used, size, some = stack[-1]
            pattern, times = next(some, (None, 0))
            if pattern is None:
                stack.pop()
                continue
            after = dict(left)
            for x in pattern:
                after[x] -= times
            after = {k: v for k, v in after.items() if v}
            done, so_far, size = used + times, [*patterns, (pattern, times)], size - times * sum(pattern)
            if not after:
                if done < bins:
                    best, bins = so_far, done
                continue
            state = tuple(sorted(after.items()))
            if done + -(-size // capacity) >= bins or seen.get(state, bins) <= done:
                continue
            if len(seen) < SEEN:
                seen[state] = done
            if done + lower_bound(after, capacity) >= bins:
                continue
            stack.append((after, so_far, done, size, branches(after, done, size)))
    except StopSearch:
        pass
    return best


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Runs of slots: the pieces of a length numbered from `first` on go, one each, to sequences from `sequence` on, at `offset`."""
    rows, next_of, sequence = [], defaultdict(int), 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, next_of[length], sequence, offset))
            next_of[length] += times
            offset += length
        sequence += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {c: table[:, i] for i, c in enumerate(("length", "first", "sequence", "offset"))}


def pack(parts: DataFrame, order: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """parts with sequence_id and offset; rows of equal length take places by `order`.

    parts is read three times, so give it checkpointed or cheap.
    """
    counts = {r[0]: r[1] for r in parts.groupBy(length).count().collect()}
    table = slots(pack_lengths(counts, capacity))
    ranked = numbered(parts, length, order, "__rank")
    held = parts.sparkSession.sparkContext.broadcast(table)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    columns = parts.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        names = t["length"].astype(np.uint64) << np.uint64(48) | t["first"].astype(np.uint64)
        for batch in batches:
            rank = batch.column("__rank").to_numpy()
            name = batch.column(length).to_numpy().astype(np.uint64) << np.uint64(48) | rank.astype(np.uint64)
            at = np.searchsorted(names, name, side="right") - 1
            sequence = t["sequence"][at] + rank - t["first"][at]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(sequence), pa.array(t["offset"][at])], names=[*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(tidied(place), f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id and offset: the layout, without the ids themselves."""
    parts = pieces(docs, text, key, capacity, end, tokenizer).select(key, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(checkpointed(parts), [key, "piece", "ids_crc32"], "length", capacity)
