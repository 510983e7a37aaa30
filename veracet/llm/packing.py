"""Best-fit packing of token sequences by linear grouping.

The lengths of all pieces are counted in Spark (at most ``capacity`` distinct lengths), and the plan is made on
these counts alone:

1. large lengths (over capacity / ``LARGE``), in descending order, are cut into groups of equal cardinality and
   each rounded up to the largest of its group;
2. a linear program over configurations of these few sizes (column generation: a knapsack finds the next
   configuration) gives how many sequences use each configuration, rounded down;
3. actual pieces take the places of the rounded ones, largest first;
4. the large pieces left over and then the small ones go, in descending order, to the sequence with the least
   room that suffices, or to a new one.

Equal sequences are kept as runs, so the plan has a few thousand rows whatever the corpus.  A piece finds its
sequence by its length and its rank among the pieces of that length; ranks come from range partitions, so a
length that a third of all pieces have is not collected anywhere.

Defined results: a null or empty text is a document of its end id alone; only documents longer than the capacity
are cut; equal rows are separate documents; null doc_ids are kept; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracet.llm.store import running_total, written
from veracet.llm.tokens import encoded, tokenizer_path
from veracet.llm.words import as_binary

CAPACITY = 4096
LARGE = 8
GROUPS = 48
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, doc_ids = as_binary(batch.column("text")), batch.column("doc_id")
            for a, b, ids, count in encoded(column, path, end_id):
                ids = ids.astype("<u4")
                n = -(-count // capacity)
                row = np.repeat(np.arange(len(count)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, count[row] - start)
                at = np.repeat(np.cumsum(count) - count, n) + start
                crc = [zlib.crc32(ids[i : i + m]) for i, m in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": doc_ids.slice(a, b - a).take(pa.array(row)).cast(pa.int64()), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start),
                     "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64())}
                )

    return run


def best_configuration(size: np.ndarray, value: np.ndarray, most: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits: an unbounded knapsack, item by item."""
    best = np.zeros(capacity + 1)
    steps = [best]
    for s, v, m in zip(size.tolist(), value.tolist(), most.tolist(), strict=True):
        if v > 0:
            for _ in range(min(m, capacity // s)):
                best = np.maximum(best, np.concatenate((steps[-1][:s], best[:-s] + v)))
        steps.append(best)
    out, room = np.zeros(len(size), np.int64), capacity
    for i in range(len(size) - 1, -1, -1):
        while room >= size[i] and steps[i + 1][room] > steps[i][room] + 1e-12:
            out[i] += 1
            room -= int(size[i])
    return float(value @ out), out


def configurations(size: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 600) -> list[tuple[int, np.ndarray]]:
    """(sequences, copies of each size) by the linear program, sequences rounded down."""
    k = len(size)
    basis = np.diag((capacity // size).astype(float))
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        value, column = best_configuration(size, inverse.sum(0), np.full(k, capacity), capacity)
        if value <= 1 + 1e-7:
            break
        amount, change = inverse @ demand, inverse @ column
        ratio = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    amount = np.floor(np.linalg.solve(basis, demand) + 1e-6).astype(np.int64)
    left, out = demand.astype(np.int64).copy(), []
    for j in np.argsort(-amount, kind="stable").tolist():
        copies = np.rint(basis[:, j]).astype(np.int64)
        used = copies > 0
        times = min(int(amount[j]), int((left[used] // copies[used]).min())) if used.any() else 0
        if times > 0:
            out.append((times, copies))
            left -= times * copies
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, large: int = LARGE, groups: int = GROUPS) -> tuple[int, list[tuple[int, int, int, int, int, int]]]:
    """Number of sequences, and rows (length, first rank, pieces, first sequence, pieces a sequence, offset).

    Piece r of a row goes to sequence ``first + r // a sequence`` at ``offset + r % a sequence * length``.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    used = dict.fromkeys(counts, 0)
    left = dict(counts)
    sequences = 0
    runs: list[tuple[int, int, int]] = []  # (room, first sequence, sequences), sorted; those with no room are done

    def place(length: int, pieces: int, first: int, each: int, offset: int) -> None:
        rows.append((length, used[length], pieces, first, each, offset))
        used[length] += pieces
        left[length] -= pieces

    if n := left.get(capacity, 0):
        place(capacity, n, 0, 1, 0)
        sequences = n
    big = sorted((x for x in left if capacity > x > capacity // large and left[x]), reverse=True)
    if big:
        length, count = np.array(big), np.array([left[x] for x in big], np.int64)
        end = np.cumsum(count)
        total = int(end[-1])
        k = min(groups, len(big))
        if len(big) <= groups:
            edges = np.concatenate(([0], end))
        else:
            edges = np.unique(np.arange(k + 1) * total // k)
        size = length[np.searchsorted(end, edges[:-1], "right")]  # the largest of each group
        demand = np.diff(edges)
        merged, which = np.unique(-size, return_inverse=True)  # groups whose largest lengths are equal are one
        size, demand = -merged, np.bincount(which, weights=demand).astype(np.int64)
        # places in the descending list that each group still has to give
        give = (np.cumsum(demand) - demand).tolist()
        for times, copies in configurations(size, demand, capacity):
            slots = [g for g in range(len(size)) for _ in range(int(copies[g]))]
            cuts = {0, times}
            spans = []
            for g in slots:  # each slot takes the next ``times`` pieces of its group, one a sequence
                a = give[g]
                give[g] += times
                i = int(np.searchsorted(end, a, "right"))
                at, span = 0, []
                while at < times:
                    m = min(times - at, int(end[i]) - a - at)
                    span.append((at, int(length[i]), m))
                    at += m
                    cuts.add(at)
                    i += 1
                spans.append(span)
            cuts_at = sorted(cuts)
            offset = dict.fromkeys(cuts_at[:-1], 0)
            for span in spans:
                for at, x, m in span:
                    inside = [c for c in cuts_at[bisect_left(cuts_at, at) : bisect_left(cuts_at, at + m)]]
                    for c, d in zip(inside, [*inside[1:], at + m], strict=True):
                        place(x, d - c, sequences + c, 1, offset[c])
                        offset[c] += x
            for c, d in zip(cuts_at[:-1], cuts_at[1:], strict=True):
                if room := capacity - offset[c]:
                    insort(runs, (room, sequences + c, d - c))
            sequences += times
    for x in sorted(left, reverse=True):
        while left[x]:
            i = bisect_left(runs, (x, -1, -1))
            if i < len(runs):
                room, first, n = runs.pop(i)
            else:
                each = capacity // x
                room, first, n = capacity, sequences, max(1, left[x] // each)
                sequences += n
            each = room // x
            full = min(n, left[x] // each)
            parts = [(full, each)]
            if full < n:
                parts.append((1, left[x] - full * each))
                parts.append((n - full - 1, 0))
            at = first
            for m, taken in parts:
                if m > 0:
                    if taken:
                        place(x, m * taken, at, taken, capacity - room)
                    if rest := room - taken * x:
                        insort(runs, (rest, at, m))
                    at += m
    return sequences, rows


def _placed(rows: list[tuple[int, int, int, int, int, int]]):
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    key = (table[:, 0].astype(object) << 48) + table[:, 1] if len(table) else np.zeros(0, object)
    key = np.array(key, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = table[np.searchsorted(key, (length << 48) + rank, "right") - 1]
            r = rank - at[:, 1]
            sequence = at[:, 3] + r // at[:, 4]
            offset = at[:, 5] + r % at[:, 4] * length
            cols = [batch.column(c.split()[0]) for c in _PIECE.split(", ")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], [*[c.split()[0] for c in _PIECE.split(", ")], "sequence_id", "offset"])

    return run


def packed(documents: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    vocabulary = tokenizer if "/" in tokenizer else tokenizer_path(tokenizer)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = written(rows.mapInArrow(_pieces(vocabulary, end_id, capacity), _PIECE), "pieces")
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    ranked = running_total(pieces.withColumn("_one", F.lit(1)), ["length"], ["doc_id", "piece"], "_one", "rank", "ranked")
    _, rows_of_plan = plan(counts, capacity)
    return ranked.select(*[c.split()[0] for c in _PIECE.split(", ")], "rank").mapInArrow(_placed(rows_of_plan), f"{_PIECE}, sequence_id long, offset long")
