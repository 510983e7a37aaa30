"""N-gram Jaccard join by parity sketches.

A document's set is its distinct shingles of ``SHINGLE`` words (A-Z in lower case).  Two documents link if
100 * intersection >= ``PERCENT`` * union; linked documents share a component.

1. Sets that are equal are one class (known by a 128-bit hash of the set), so copies of any number cost one node.
2. Each shingle flips one bit of a parity sketch (XOR), so the Hamming distance of two sketches is a lower bound of the
   symmetric difference of their sets.  Sets of sizes a <= b that link differ in (1 - t) / (1 + t) * (a + b) shingles at
   most, t being the similarity.
3. Pigeonhole: for each size band the hash space, a sketch with a bit for every hash, is cut into pieces, more than the
   bound by half.  A piece's parity bits are held as the XOR of a random word for each bit that is set: equal bits have equal
   words.  A shingle that only one set has spoils one piece, so linking sets have equal pieces: of those that one of
   them fills, all but as many as the bound.  Pieces go to their owners as packed arrays, and the sources hear which are
   shared and by how many.
4. A set that shares fewer pieces than any partner would need falls away at its source.  The others list their shared
   pieces, rarest first, and only the first ones are groups to search: all but the last that must be shared (a common piece is
   then in both lists).  Passages and lines in common make few equal pieces, and those the most frequent.
5. Groups are never paired out.  Each node is compared with the first node of a group that it shares most groups with;
   links are verified on the real sets, and components formed.  Groups with several components are then searched by
   narrow sketches laid out in bits: of the nodes of other components whose Hamming distance is within the bound, each node
   names the nearest, which are verified and merged; and then all that are left are named and verified.  A link that
   is never compared lies inside a component.  Groups beyond ``SPLIT`` nodes are compared in blocks, by many tasks.

Defined results: null text, or text without words, has an empty set and links with nothing; a text with fewer
words than a shingle has one shingle, the whole of it; null doc_ids take part, and a component's id is the
smallest that is not null; repeated rows are copies; an empty table gives an empty result; other columns are ignored (and
kept by ``one_of_each``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracet.llm.store import drop, join_small, new_path, written
from veracet.llm.words import as_binary, mix, prefix_hash, range_hash, released, slices, split_words

SHINGLE = 5
PERCENT = 80
#: Pieces for each shingle that linking sets of a band may differ in, and the least number of pieces.
MORE_PIECES = 1.6
LEAST_PIECES = 64
#: Entries that a task holds before it sends them on.
HELD = 500_000
#: Buckets for each shuffle partition: a task sorts one bucket at a time.
BUCKETS = 2
#: Nodes of a group that one task compares with each other.
SPLIT = 4096
#: Bits of a narrow sketch: the power of two from ``WIDE`` times the size on, within these bounds.
WIDE, LEAST_BITS, MOST_BITS = 4, 64, 8192
#: A node's number: the partition and the flush (``uid``), then its place there.
_PLACE_BITS, _FLUSH_BITS = 24, 16
_SKETCH = "kind string, doc_id long, text_hash long, n_shingles long, f1 long, f2 long, node long, bucket int, uid long, packed binary"
_PAIRS = "x long, y long, n long"


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes, sorted, one after the other; and each row's count."""
    words = split_words(column, lower=True)
    n = np.diff(words.first)
    rows = len(n)
    if not len(words.start):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    prefix = prefix_hash(words.data)
    short = np.flatnonzero((n > 0) & (n < shingle))
    hashes = [range_hash(prefix, words.start[words.first[short]], words.end[words.first[short + 1] - 1])]
    row = [short]
    many = len(words.start) - shingle + 1
    if many > 0:
        of = np.repeat(np.arange(rows), n)
        ok = np.flatnonzero(of[:many] == of[shingle - 1 :])
        hashes.append(range_hash(prefix, words.start[ok], words.end[ok + shingle - 1]))
        row.append(of[ok])
    h, r = np.concatenate(hashes), np.concatenate(row)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], np.bincount(r[new], minlength=rows)


def first_size(percent: int) -> int | None:
    """The smallest set that links with another one; None if only equal sets link."""
    return -(-percent // (100 - percent)) if percent < 100 else None


def bands(size: int, percent: int = PERCENT) -> list[tuple[int, int, bool]]:
    """The schemes a set of this size takes part in: (begin, largest size, whether it may be the smaller set)."""
    out, begin = [], first_size(percent)
    while begin is not None and begin <= size:
        end = begin + max(1, begin // 2)
        largest = end - 1
        if size <= largest:
            out.append((begin, largest, True))
        elif size <= largest * 100 // percent:
            out.append((begin, largest, False))
        begin = end
    return out


def bound(a: int | np.ndarray, b: int | np.ndarray, percent: int = PERCENT):
    """The largest symmetric difference of linking sets of these sizes."""
    return (a + b) * (100 - percent) // (100 + percent)


def entries(hashes: np.ndarray, words: np.ndarray, percent: int = PERCENT) -> list[tuple[np.ndarray, int, bool]]:
    """For each scheme of the set: 64-bit keys of its pieces, how many a partner must share, whether it may be the smaller.

    hashes: the set, ascending; words: the random word of each.
    """
    size, out = len(hashes), []
    high = hashes >> np.uint64(32)
    for begin, largest, own in bands(size, percent):
        most = bound(largest, largest * 100 // percent, percent)
        pieces = max(int(most * MORE_PIECES) + 2, LEAST_PIECES)
        piece = high * np.uint64(pieces) >> np.uint64(32)
        at = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
        scheme = np.uint64(begin) << np.uint64(40)
        keys = mix(mix(np.bitwise_xor.reduceat(words, at) ^ scheme) ^ piece[at])
        if len(keys) > most:
            need = max(1, len(keys) - bound(size, size * 100 // percent if own else largest, percent))
        else:  # so few filled pieces that an empty one may be the only equal one
            empty = np.setdiff1d(np.arange(pieces, dtype=np.uint64), piece)
            keys, need = np.concatenate((keys, mix(mix(np.full(len(empty), scheme)) ^ empty))), 1
        out.append((keys, need, own))
    return out


def narrow(hashes: np.ndarray) -> np.ndarray:
    """The parity sketch of a set, laid out in 64-bit words."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (WIDE * len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of one width, the least of theirs: a bit is the parity of those that meet in it."""
    width = min(map(len, sketches)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, width), axis=0) for s in sketches])


class _Flush:
    """What a task holds until it sends it: entries (bucket, key, signature) and the heads of signatures."""

    def __init__(self, uid: int):
        self.uid, self.nodes, self.n = uid, 0, 0
        self.heads: list[tuple[int, int, int, bool]] = []
        self.keys: list[np.ndarray] = []
        self.count: list[int] = []

    def node(self) -> int:
        self.nodes += 1
        return self.uid << _PLACE_BITS | (self.nodes - 1)

    def add(self, node: int, size: int, keys: np.ndarray, need: int, own: bool) -> None:
        self.heads.append((node & ((1 << _PLACE_BITS) - 1), size, need, own))
        self.keys.append(keys)
        self.count.append(len(keys))
        self.n += len(keys)

    def rows(self, buckets: int) -> tuple[list[int], list[bytes], bytes]:
        """(buckets, their packed entries, packed heads)."""
        key = np.concatenate(self.keys)
        heads = np.array([h[:3] for h in self.heads], "<u4")
        own = np.array([h[3] for h in self.heads], "<u4")
        signature = np.repeat(np.arange(len(self.count), dtype=np.uint32) << 1 | own, self.count)
        bucket = (key & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        bucket, key, signature = bucket[order], (key[order] >> np.uint64(32)).astype("<u4"), signature[order]
        at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        end = np.append(at[1:], len(bucket))
        parts = [_packed(signature[i:j], key[i:j]) for i, j in zip(at.tolist(), end.tolist(), strict=True)]
        return bucket[at].astype(np.int32).tolist(), parts, heads.tobytes() + own.astype("u1").tobytes()


def _packed(signature: np.ndarray, key: np.ndarray) -> bytes:
    """Ascending signatures as differences, then the keys."""
    step = np.diff(signature, prepend=np.uint32(0))
    kind = "<u2" if int(step.max()) < 1 << 16 else "<u4"
    return bytes([int(kind[-1])]) + step.astype(kind).tobytes() + key.tobytes()


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide = raw[0]
    n = (len(raw) - 1) // (wide + 4)
    step = np.frombuffer(raw, f"<u{wide}", n, 1)
    return np.cumsum(step, dtype=np.uint32), np.frombuffer(raw, "<u4", n, 1 + wide * n)


_SKETCHED = pa.schema([
    ("kind", pa.string()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("node", pa.int64()),
    ("bucket", pa.int32()), ("uid", pa.int64()), ("packed", pa.binary()),
])


def _sketched(buckets: int, percent: int, shingle: int):
    def table(size: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(size, f.type) for f in _SKETCHED], schema=_SKETCHED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], int] = {}
        task = TaskContext.get().partitionId() << _FLUSH_BITS
        held = _Flush(task)

        def sent() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if held.n:
                bucket, parts, heads = held.rows(buckets)
                yield table(len(bucket), kind=["e"] * len(bucket), bucket=bucket, uid=[held.uid] * len(bucket), packed=parts)
                yield table(1, kind=["h"], uid=[held.uid], packed=[heads])
            held = _Flush(held.uid + 1)

        for batch in batches:
            column, text_hash, ids = as_binary(batch.column("text")), batch.column("text_hash"), batch.column("doc_id")
            for i, j in slices(column):
                hashes, count = shingle_sets(column.slice(i, j - i), shingle)
                end = np.cumsum(count)
                one, two = mix(hashes), mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
                total = np.concatenate((np.zeros((2, 1), np.uint64), np.cumsum((one, two), axis=1, dtype=np.uint64)), axis=1)
                f1, f2 = mix(total[0][end] - total[0][end - count] + count.astype(np.uint64)), total[1][end] - total[1][end - count]
                nodes: list[int | None] = [None] * (j - i)
                for r in np.flatnonzero(count).tolist():
                    k = (int(f1[r]), int(f2[r]))
                    node = known.get(k)
                    if node is None:
                        node = known[k] = held.node()
                        here = slice(end[r] - count[r], end[r])
                        for keys, need, own in entries(hashes[here], two[here], percent):
                            held.add(node, int(count[r]), keys, need, own)
                    nodes[r] = node
                yield table(j - i, kind=["d"] * (j - i), doc_id=ids.slice(i, j - i), text_hash=text_hash.slice(i, j - i), n_shingles=count, f1=f1.view(np.int64), f2=f2.view(np.int64), node=nodes)
                if held.n > HELD or held.nodes > HELD:
                    yield from sent()
        yield from sent()
        released()

    return run


_REPLY = "kind string, uid long, node long, packed binary"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket, the pieces that two or more signatures have, one at least as the smaller set: to each source a
    packed row (bucket; signatures, how many have the piece, keys).  Rows come sorted by bucket."""
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    bucket = None

    def replies() -> Iterator[pa.RecordBatch]:
        key = np.concatenate([h[2] for h in held]).astype(np.uint64)
        signature = np.concatenate([h[1] for h in held])
        uid = np.repeat(np.array([h[0] for h in held], np.int64), [len(h[1]) for h in held])
        held.clear()
        order = np.sort(key << np.uint64(32) | np.arange(len(key), dtype=np.uint64))
        key, order = order >> np.uint64(32), (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(at, len(key)))
        signature = signature[order]
        good = (size > 1) & (np.add.reduceat((signature & 1).astype(np.int64), at) > 0)
        keep = np.repeat(good, size)
        uid, signature, key, size = uid[order][keep], signature[keep] >> 1, key[keep].astype("<u4"), np.repeat(size[good], size[good]).astype("<u4")
        if not len(uid):
            return
        order = np.argsort(uid, kind="stable")
        uid, signature, key, size = uid[order], signature[order], key[order], size[order]
        at = np.flatnonzero(np.concatenate(([True], uid[1:] != uid[:-1])))
        head = np.array([bucket], "<u4").tobytes()
        parts = [head + np.concatenate((signature[i:j], size[i:j], key[i:j])).tobytes() for i, j in zip(at.tolist(), np.append(at[1:], len(uid)).tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"kind": pa.array(["r"] * len(at)), "uid": pa.array(uid[at]), "node": pa.nulls(len(at), pa.int64()), "packed": pa.array(parts, pa.binary())})

    for batch in batches:
        for b, uid, raw in zip(batch.column("bucket").to_pylist(), batch.column("uid").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            if held and b != bucket:
                yield from replies()
            bucket = b
            held.append((uid, *_unpacked(raw)))
    if held:
        yield from replies()
    released()


#: g: the group (bucket << 32 | key); meta: the set's size << 1 | whether it may be the smaller set there.
_MEMBERS = "g long, node long, meta long"


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each signature that shares enough pieces, the groups to search.  Rows (heads, replies, and nodes whose
    class another node stands for) come sorted by uid."""
    held: dict[str, list] = {"h": [], "r": [], "x": []}
    uid = None

    def members() -> Iterator[pa.RecordBatch]:
        raw, replies, gone = held["h"][0] if held["h"] else b"", list(held["r"]), [n & ((1 << _PLACE_BITS) - 1) for n in held["x"]]
        for rows in held.values():
            rows.clear()
        if not raw or not replies:
            return
        n = len(raw) // 13
        heads, own = np.frombuffer(raw, "<u4", 3 * n).reshape(n, 3).astype(np.int64), np.frombuffer(raw, "u1", n, 12 * n).astype(np.int64)
        place, size, need = heads.T
        parts = [np.frombuffer(r, "<u4", -1, 4).reshape(3, -1).astype(np.int64) for r in replies]
        bucket = np.repeat([int.from_bytes(r[:4], "little") for r in replies], [p.shape[1] for p in parts])
        signature, often, key = np.concatenate(parts, axis=1)
        count = np.bincount(signature, minlength=n)
        alive = (count >= need) & ~np.isin(place, gone)
        keep = alive[signature]
        signature, often, g = signature[keep], often[keep], (bucket << 32 | key)[keep]
        order = np.lexsort((g, often, signature))
        signature, g = signature[order], g[order]
        count = np.bincount(signature, minlength=n)
        rank = np.arange(len(signature)) - (np.cumsum(count) - count)[signature]
        first = rank <= (count - need)[signature]
        s = signature[first]
        yield pa.RecordBatch.from_arrays([pa.array(g[first]), pa.array(uid << _PLACE_BITS | place[s]), pa.array(size[s] << 1 | own[s])], ["g", "node", "meta"])

    for batch in batches:
        for kind, u, node, raw in zip(*(batch.column(c).to_pylist() for c in ("kind", "uid", "node", "packed")), strict=True):
            if uid is not None and u != uid:
                yield from members()
            uid = u
            held[kind].append(node if kind == "x" else raw)
    if uid is not None:
        yield from members()
    released()


def _may_link(size_a: np.ndarray, own_a: np.ndarray, size_b: np.ndarray, own_b: np.ndarray, percent: int) -> np.ndarray:
    """One of the two may be the smaller set here, and the sizes are near enough."""
    return ((own_a | own_b) > 0) & (np.minimum(size_a, size_b) * 100 >= np.maximum(size_a, size_b) * percent)


def _stars(percent: int):
    """In each group, the pairs of its first node with the others; rows come sorted by group, of which only the first
    is held.  n: how often the pair is met in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            g, node, meta = (batch.column(c).to_numpy() for c in ("g", "node", "meta"))
            if not len(g):
                continue
            if last is not None and last[0] == g[0]:
                g, node, meta = (np.concatenate(([v], a)) for v, a in zip(last, (g, node, meta), strict=True))
            at = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            first = np.repeat(at, np.diff(np.append(at, len(g))))
            last = (g[at[-1]], node[at[-1]], meta[at[-1]])
            ok = (node[first] != node) & _may_link(meta[first] >> 1, meta[first] & 1, meta >> 1, meta & 1, percent)
            x, y = node[first][ok], node[ok]
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            new = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[new]), pa.array(y[new]), pa.array(np.diff(np.append(new, len(x))))], ["x", "y", "n"])

    return run


_CELL = ["g", "i", "j", "node", "component", "meta", "block", "sketch"]


def _within(percent: int, nearest: bool):
    """Rows of cells (blocks i and j of a group; sorted so): pairs of nodes of different components whose narrow sketches
    are within the bound, n being their Hamming distance; with ``nearest``, for each node only the nearest."""

    def pairs(rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        _, i, j, *_ = rows[0]
        node, component, meta, block = (np.array([r[k] for r in rows], np.int64) for k in range(3, 7))
        sketch = folded([r[7] for r in rows])
        size, own = meta >> 1, meta & 1
        least = np.full(len(rows), np.iinfo(np.int64).max)
        partner = np.full(len(rows), -1)
        for a in range(len(rows) - 1):
            b = np.arange(a + 1, len(rows))
            ok = (component[b] != component[a]) & _may_link(size[b], own[b], size[a], own[a], percent)
            if i != j:
                ok &= block[b] != block[a]
            b = b[ok]
            if not len(b):
                continue
            distance = np.bitwise_count(sketch[b] ^ sketch[a]).sum(axis=1, dtype=np.int64)
            near = distance <= bound(size[b], size[a], percent)
            b, distance = b[near], distance[near]
            if not len(b):
                continue
            if nearest:
                better = distance < least[b]
                least[b[better]], partner[b[better]] = distance[better], a
                k = int(distance.argmin())
                if distance[k] < least[a]:
                    least[a], partner[a] = distance[k], b[k]
            else:
                yield np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), distance
        some = partner >= 0
        if some.any():
            yield node[some], node[partner[some]], least[some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n_found = 0

        def sent() -> Iterator[pa.RecordBatch]:
            nonlocal n_found
            if found:
                x, y, n = map(np.concatenate, zip(*found, strict=True))
                order = np.lexsort((n, y, x))
                x, y, n = x[order], y[order], n[order]
                new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(x[new]), pa.array(y[new]), pa.array(n[new])], ["x", "y", "n"])
            found.clear()
            n_found = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal n_found
            for some in pairs(held):
                found.append(some)
                n_found += len(some[0])
                if n_found > HELD:
                    yield from sent()
            held.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _CELL), strict=True):
                if held and row[:3] != held[0][:3]:
                    yield from close()
                held.append(row)
        if held:
            yield from close()
        yield from sent()

    return run


def _compared(percent: int):
    """Rows x, y and their sets to the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (s, t) in enumerate(zip(batch.column("set_x").to_pylist(), batch.column("set_y").to_pylist(), strict=True)):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    keep.append(i)
            yield batch.select(["x", "y"]).take(pa.array(keep, pa.int64()))

    return run


def _laid_out(shingle: int):
    """Rows node, text to the node's real set and its narrow sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, node = as_binary(batch.column("text")), batch.column("node")
            for i, j in slices(column):
                hashes, count = shingle_sets(column.slice(i, j - i), shingle)
                sets = np.split(hashes, np.cumsum(count)[:-1])
                yield pa.RecordBatch.from_arrays([node.slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([narrow(s).tobytes() for s in sets], pa.binary())], ["node", "hashes", "sketch"])

    return run


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the least node reachable by links (x, y).  Labels are hooked and halved until none changes."""
    spark = links.sparkSession
    edges = written(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), name)
    path = new_path(spark, name)
    label = written(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("component")).withColumnRenamed("x", "node"), name, path)
    while True:
        near = edges.join(label, edges["y"] == label["node"]).groupBy("x").agg(F.min("component").alias("_near"))
        step = label.join(near, label["node"] == near["x"]).select("node", F.col("component").alias("_old"), F.least("component", "_near").alias("component"))
        up = label.select(F.col("node").alias("_up"), F.col("component").alias("_far"))
        step = step.join(up, step["component"] == up["_up"], "left")
        old, path = path, new_path(spark, name)
        step = written(step.select("node", "_old", F.least("component", F.coalesce("_far", F.col("component"))).alias("component")), name, path)
        drop(spark, old)
        changed = not step.filter("_old <> component").isEmpty()
        label = step.select("node", "component")
        if not changed:
            return label


def _sets(nodes: DataFrame, classes: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes, sketch) of the nodes asked for: a class's set is that of one of its texts."""
    wanted = written(nodes.join(classes.select("node", "one"), "node").select("node", F.col("one.text_hash").alias("_h"), F.col("one.doc_id").alias("_d")), "wanted")
    same = (F.col("text_hash") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    texts = join_small(rows, wanted, same, "inner").select("node", "text")
    return written(texts.mapInArrow(_laid_out(shingle), "node long, hashes binary, sketch binary").dropDuplicates(["node"]), "class-sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) of nodes whose real sets link."""
    x = sets.select(F.col("node").alias("x"), F.col("hashes").alias("set_x"))
    y = sets.select(F.col("node").alias("y"), F.col("hashes").alias("set_y"))
    return written(pairs.select("x", "y").join(x, "x").join(y, "y").mapInArrow(_compared(percent), "x long, y long"), "links", rows=200)


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of groups that have several components, with them, and how many nodes the group has."""
    rows = join_small(members.select("g", "node", "meta"), found, "node").withColumn("component", F.coalesce("component", "node"))
    rows = written(rows, "members")
    several = rows.groupBy("g").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.count("*").alias("nodes")).filter("_a <> _b")
    return written(join_small(rows, written(several.select("g", "nodes"), "mixed"), "g", "inner"), "mixed-members")


def _near_pairs(rows: DataFrame, sets: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Counted pairs across components within the bound; groups beyond ``SPLIT`` nodes are dealt out as pairs of blocks."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.ceil(F.col("nodes") / SPLIT)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.withColumns({"i": F.least("block", "_other"), "j": F.greatest("block", "_other")})
    rows = rows.join(sets.select("node", "sketch"), "node").select(*_CELL)
    return rows.repartition(n, "g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(_within(percent, nearest), _PAIRS)


def _named(ends: DataFrame, best: Column) -> DataFrame:
    """One pair for each node: the best one; ends: node, x, y and what ``best`` compares."""
    pairs = ends.groupBy("node").agg(best.alias("_p")).select(F.least("_p.x", "_p.y").alias("x"), F.greatest("_p.x", "_p.y").alias("y"))
    return pairs.distinct()


def linked(documents: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of documents: doc_id, n_shingles, component_id."""
    spark = documents.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    path = new_path(spark, "sketches")
    made = written(rows.mapInArrow(_sketched(BUCKETS * n, percent, shingle), _SKETCH), "sketches", path)
    base = made.filter("kind = 'd'").select("doc_id", "n_shingles", "f1", "f2", "node", "text_hash")
    nodes = base.filter("n_shingles > 0").groupBy("node", "f1", "f2").agg(F.min("doc_id").alias("least"), F.min(F.struct("text_hash", "doc_id")).alias("one"), F.count("*").alias("copies"))
    nodes = written(nodes, "nodes")
    classes = nodes.groupBy("f1", "f2").agg(F.min("node").alias("node"), F.min("least").alias("least"), F.min("one").alias("one"), F.sum("copies").alias("copies"), F.count("*").alias("nodes"))
    classes = written(classes, "classes")
    base = written(base.select("doc_id", "n_shingles", "f1", "f2"), "sets")

    sent = made.filter("kind = 'e'").select("bucket", "uid", "packed").repartition(n, "bucket").sortWithinPartitions("bucket")
    none = F.lit(None)
    double = nodes.join(classes.filter("nodes > 1").select("f1", "f2", F.col("node").alias("_first")), ["f1", "f2"]).filter("node <> _first")
    double = double.select(F.lit("x").alias("kind"), F.shiftright("node", _PLACE_BITS).alias("uid"), "node", none.cast("binary").alias("packed"))
    heads = made.filter("kind = 'h'").select("kind", "uid", none.cast("long").alias("node"), "packed")
    replies = sent.mapInArrow(_shared, _REPLY).unionByName(heads).unionByName(double)
    members = written(replies.repartition(n, "uid").sortWithinPartitions("uid").mapInArrow(_listed, _MEMBERS), "listed")
    drop(spark, path)

    stars = members.repartition(n, "g").sortWithinPartitions("g", "node").mapInArrow(_stars(percent), _PAIRS)
    stars = written(stars.groupBy("x", "y").agg(F.sum("n").alias("n")), "stars")
    ends = stars.select(F.col("x").alias("node"), "x", "y", "n").unionByName(stars.select(F.col("y").alias("node"), "x", "y", "n"))
    sets = _sets(members.select("node").distinct(), classes, rows, shingle)
    first = written(_named(ends, F.max(F.struct("n", "x", "y"))), "first-pairs")
    links = _verified(first, sets, percent)
    found = components(links)

    mixed = _mixed(members, found)
    near = _near_pairs(mixed, sets, percent, nearest=True)
    named = written(_named(near.withColumn("node", F.col("x")), F.min(F.struct("n", "x", "y"))), "named")
    if not named.isEmpty():
        second = written(named.join(first, ["x", "y"], "left_anti"), "second-pairs")
        links = links.unionByName(_verified(second, sets, percent))
        found = components(links)
        third = _near_pairs(_mixed(mixed, found), sets, percent, nearest=False).select("x", "y").distinct()
        third = written(third.join(first.unionByName(second), ["x", "y"], "left_anti"), "third-pairs")
        if not third.isEmpty():
            links = links.unionByName(_verified(third, sets, percent))
            found = components(links)

    node = classes.join(found, "node", "left").select("f1", "f2", "least", "copies", F.coalesce("component", "node").alias("component"))
    node = written(node, "labels")
    least = node.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("sets"))
    node = node.join(least, "component").filter("sets > 1 or copies > 1").select("f1", "f2", "component_id")
    out = join_small(base, written(node, "component-ids"), ["f1", "f2"])
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """The documents, of each component only one: the row with the smallest doc_id (of repeated rows, one).
    Rows with a null doc_id stay."""
    found = written(linked(documents, **options), "linked")
    gone = written(found.filter("doc_id > component_id").select(F.col("doc_id").alias("__veracet_id")).distinct(), "gone")
    rest = join_small(documents, gone, F.col("doc_id") == F.col("__veracet_id"), "left_anti")
    twice = found.filter("doc_id = component_id and n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("doc_id").alias("__veracet_id"))
    twice = written(twice, "twice")
    if twice.isEmpty():
        return rest
    same = F.col("doc_id") == F.col("__veracet_id")
    return join_small(rest, twice, same, "left_anti").unionByName(join_small(rest, twice, same, "left_semi").dropDuplicates(["doc_id"]))
