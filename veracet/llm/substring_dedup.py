"""Substring dedup by super-k-mers of words.

A window is ``WINDOW`` consecutive words of one document; its minimiser is the least hash among the runs of
``MINIMISER`` words in it.  Consecutive windows with one minimiser travel as one packed string (their words
joined by spaces) to the bucket of that minimiser, where the strings are sorted and their windows counted by
their bytes.  Equal windows have equal minimisers, so each is counted whole in one bucket.  What comes back is,
for each text, the ranges of words covered by repeated windows; texts are known by a 128-bit hash, so equal texts share them.

Skew: a partition sends a text twice at most (a third copy changes no verdict); a bucket that outgrows
``BUCKET_ROWS`` distinct strings sends its windows on one by one, and those are counted by a grouped sum that combines
before the shuffle.

Defined results: null text has no words; texts with fewer than WINDOW words lose none; windows are judged on
the input, so all occurrences of a repeated window go; repeated rows are repeated documents; an empty table gives
an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracet.llm.store import join_small, written
from veracet.llm.words import Words, as_binary, binaries, released, row_of, slices, split_words, spread

WINDOW = 35
MINIMISER = 5
BUCKET_ROWS = 50_000
#: Strings of a bucket beyond which its windows aren't all held at once.
LARGE = 1_000
_PACKED = "key long, packed binary, inner boolean, a long, b long, first int"
_FOUND = "a long, b long, first int, n int, window binary"


def _hashes() -> tuple[Column, Column]:
    return F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), F.col("text")).alias("b")


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    size, best = 1, x
    while 2 * size <= width:
        best = np.minimum(best[: len(best) - size], best[size:])
        size *= 2
    rest = width - size
    return np.minimum(best[: len(best) - rest], best[rest:]) if rest else best


def super_kmers(words: Words, window: int = WINDOW, minimiser: int = MINIMISER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of windows with one minimiser: the minimiser, the first window, windows, and whether it may
    hold one window twice."""
    n = len(words.start) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.astype(np.uint64), none, none, none.astype(bool)
    row = row_of(words.first)
    ok = np.flatnonzero(row[:n] == row[window - 1 :])
    if not len(ok):
        return none.astype(np.uint64), none, none, none.astype(bool)
    least = sliding_min(words.hashes(minimiser), window - minimiser + 1)[ok]
    new = np.ones(len(ok), bool)
    new[1:] = (least[1:] != least[:-1]) | (ok[1:] != ok[:-1] + 1)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(ok)))
    whole = words.hashes(window)[ok]
    run = np.repeat(np.arange(len(begin)), count)
    order = np.lexsort((whole, run))
    twice = (whole[order][1:] == whole[order][:-1]) & (run[order][1:] == run[order][:-1])
    inner = np.zeros(len(begin), bool)
    inner[run[order][1:][twice]] = True
    return least[begin], ok[begin], count, inner


def _sent(window: int, minimiser: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            fresh = np.zeros(len(a), bool)
            for i, k in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                had = seen.get(k, 0)
                if had < 2:
                    seen[k] = had + 1
                    fresh[i] = True
            rows = pa.array(np.flatnonzero(fresh))
            column, a, b = as_binary(batch.column("text").take(rows)), a[fresh], b[fresh]
            for i, j in slices(column):
                words = split_words(column.slice(i, j - i))
                key, at, count, inner = super_kmers(words, window, minimiser)
                if not len(key):
                    continue
                start, end = words.start[at], words.end[at + count + window - 2]
                row = np.searchsorted(words.first, at, "right") - 1
                yield pa.RecordBatch.from_pydict(
                    {"key": pa.array(key.view(np.int64)), "packed": binaries(words.data[spread(start, end - start)], end - start), "inner": pa.array(inner),
                     "a": pa.array(a[i + row]), "b": pa.array(b[i + row]), "first": pa.array((at - words.first[row]).astype(np.int32))}
                )

    return run


def _windows(packed: bytes, window: int) -> list[bytes]:
    begin, at = [0], packed.find(b" ")
    while at >= 0:
        begin.append(at + 1)
        at = packed.find(b" ", at + 1)
    begin.append(len(packed) + 1)
    return [packed[begin[i] : begin[i + window] - 1] for i in range(len(begin) - window)]


def _often(held: dict[bytes, list], window: int) -> dict[bytes, int]:
    """How often each window occurs in a bucket's strings; of a large bucket only those that may occur twice, by their
    hashes, as most windows of a bucket are its strings' different ends."""
    many = None
    if len(held) > LARGE:
        value, n = np.unique(np.fromiter((hash(text) for packed in held for text in _windows(packed, window)), np.int64), return_counts=True)
        many = set(value[n > 1].tolist())
    count: dict[bytes, int] = {}
    for packed, rows in held.items():
        for text in _windows(packed, window):
            if many is None or len(rows) > 1 or hash(text) in many:
                count[text] = count.get(text, 0) + len(rows)
    return count


def _counted(window: int, bucket_rows: int):
    """Rows come sorted by (key, packed); yields ranges of repeated windows, or single windows of too large buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int, bytes | None]] = []
        held: dict[bytes, list[tuple[int, int, int]]] = {}
        held_key, held_inner, n_held, flood = None, False, 0, False

        def single() -> None:
            for packed, rows in held.items():
                for i, text in enumerate(_windows(packed, window)):
                    out.extend((a, b, first + i, 1, text) for a, b, first in rows)
            held.clear()

        def close() -> None:
            nonlocal n_held, held_inner, flood
            if flood:
                single()
            elif n_held > 1 or held_inner:
                if len(held) == 1 and n_held > 1:
                    (packed, rows), n = next(iter(held.items())), None
                    n = packed.count(b" ") + 2 - window
                    out.extend((a, b, first, n, None) for a, b, first in rows)
                else:
                    count = _often(held, window)
                    for packed, rows in held.items():
                        begin = None
                        for i, text in enumerate([*_windows(packed, window), None]):
                            if text is not None and count.get(text, 0) > 1:
                                begin = i if begin is None else begin
                            elif begin is not None:
                                out.extend((a, b, first + begin, i - begin, None) for a, b, first in rows)
                                begin = None
                    if len(held) > LARGE:
                        del count
                        held.clear()
                        released()
            held.clear()
            n_held, held_inner, flood = 0, False, False

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            out.clear()
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [c.split()[0] for c in _FOUND.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            inner = batch.column("inner").to_numpy(zero_copy_only=False)
            # a row that shares its key with neither neighbour is done unless it repeats a window itself
            alone = np.ones(len(key), bool)
            alone[1:] &= key[1:] != key[:-1]
            alone[:-1] &= key[:-1] != key[1:]
            alone[[0, -1]] = False
            todo = np.flatnonzero(~alone | inner)
            rest = batch.take(pa.array(todo)).select(["packed", "a", "b", "first"])
            for k, i, packed, a, b, first in zip(key[todo].tolist(), inner[todo].tolist(), *(c.to_pylist() for c in rest.columns), strict=True):
                if k != held_key:
                    close()
                    held_key = k
                held.setdefault(packed, []).append((a, b, first))
                n_held += 1
                held_inner |= i
                if n_held >= bucket_rows:
                    flood = True
                    single()
                    n_held = 0
                if len(out) >= 20_000:
                    yield batch_of()
            if out:
                yield batch_of()
        close()
        if out:
            yield batch_of()

    return run


def repeated_ranges(documents: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b, ranges): for each text, known by its two hashes, the [from, to) ranges of words in repeated windows."""
    spark = documents.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select("text", *_hashes()).filter("text is not null")
    sent = rows.mapInArrow(_sent(window, minimiser), _PACKED)
    found = written(sent.repartition(n, "key").sortWithinPartitions("key", "packed").mapInArrow(_counted(window, bucket_rows), _FOUND), "windows")
    ranges = found.filter("window is null").select("a", "b", "first", "n")
    single = found.filter("window is not null")
    if not single.isEmpty():
        often = single.groupBy("window").agg(F.count("*").alias("c")).filter("c > 1").select("window")
        ranges = ranges.unionByName(single.join(often, "window", "left_semi").select("a", "b", "first", "n"))
    # a text's copies give equal ranges; what is left is bounded by the text
    ranges = ranges.distinct().groupBy("a", "b")
    return ranges.agg(F.sort_array(F.collect_list(F.struct(F.col("first").alias("at"), (F.col("first") + F.col("n") + (window - 1)).alias("to")))).alias("ranges"))


def _cleaned(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = as_binary(batch.column("text"))
            for i, j in slices(column):
                words = split_words(column.slice(i, j - i))
                part = batch.slice(i, j - i)
                n_words, n_removed, sha, texts = np.diff(words.first), [], [], []
                for row, ranges in enumerate(part.column("ranges").to_pylist()):
                    first, last = int(words.first[row]), int(words.first[row + 1])
                    removed, kept = 0, [(first, last)]
                    if ranges:
                        kept, at = [], first
                        for r in ranges:
                            if first + r["at"] > at:
                                kept.append((at, first + r["at"]))
                            at = max(at, first + r["to"])
                        if at < last:
                            kept.append((at, last))
                        removed = last - first - sum(t - f for f, t in kept)
                    text = b" ".join(words.data[words.start[f] : words.end[t - 1]].tobytes() for f, t in kept if t > f)
                    n_removed.append(removed)
                    sha.append(hashlib.sha256(text).hexdigest())
                    texts.append(text)
                cols = {"doc_id": part.column("doc_id").cast(pa.int64()), "n_words": pa.array(n_words), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
                if with_text:
                    cols["text"] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_pydict(cols)

    return run


def without_repeats(documents: DataFrame, with_text: bool = True, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text."""
    ranges = written(repeated_ranges(documents, **options), "ranges")
    rows = join_small(documents.select("doc_id", "text", *_hashes()), ranges, ["a", "b"]).select("doc_id", "text", "ranges")
    return rows.mapInArrow(_cleaned(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)
