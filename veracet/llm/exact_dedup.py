"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Each partition normalises its texts (runs of [\\x20\\x09-\\x0D] become one space), takes a sha-256 and from it
   a short fingerprint, and sends every owner of a fingerprint range its sorted distinct fingerprints,
   Golomb-Rice coded.
2. An owner decodes what it got and answers each partition with a bitmap: which of its fingerprints another
   partition has too.
3. Rows whose bit is set, or whose fingerprint occurs twice in their own partition, are suspects.  Only their
   texts are read again and grouped by their bytes; groups of more than one row are the duplicates.

A partition sends each fingerprint once, so a text that fills a third of all rows costs an owner one entry per
partition; the byte check combines equal texts before the shuffle.

Defined results: null text counts as empty; of equal texts the row with the smallest doc_id stays, null doc_id
being smaller than any; of repeated rows with one doc_id exactly one stays (the first in table order); an empty
table gives an empty result; columns other than doc_id and text are ignored (and kept by ``deduplicated``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracet.llm.store import join_small, written
from veracet.llm.words import as_binary

#: Bits beyond log2 of the rows: a row is a false suspect with a chance of about 2**-EXTRA_BITS.
EXTRA_BITS = 16
#: Names of our own beside the columns of documents, which may have any.
_ID, _SHA, _OWN = "__veracet_id", "__veracet_sha", "__veracet_own"
_SPACES = b" \t\n\x0b\x0c\r"
_ROWS = "kind string, part int, seq long, owner int, rank long, twice boolean, doc_id long, sha binary, n long, k int, payload binary"


def _normal() -> Column:
    return F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Ascending non-negative integers as Rice codes of their differences: the parameter k, and the bits."""
    if not len(values):
        return 0, b""
    delta = np.diff(values.astype(np.int64), prepend=0)
    mean = max(1.0, float(delta.mean()) * 0.6931)
    k = max(0, int(np.log2(mean)))
    q = delta >> k
    width = q + 1 + k
    end = np.cumsum(width)
    bits = np.zeros(int(end[-1]), np.uint8)
    one = end - k - 1  # q zeros, a one, then k bits of the rest
    bits[one] = 1
    for j in range(k):
        bits[one + 1 + j] = (delta >> (k - 1 - j)) & 1
    return k, np.packbits(bits).tobytes()


def golomb_decode(k: int, payload: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    bits = np.unpackbits(np.frombuffer(payload, np.uint8))
    ones = np.flatnonzero(bits).tolist()
    delta = np.empty(n, np.int64)
    starts = np.empty(n, np.int64)
    at = i = 0
    # the first one at or after each code's begin ends its unary part; ones inside the k bits are skipped
    for j in range(n):
        while ones[i] < at:
            i += 1
        delta[j] = ones[i] - at
        at = ones[i] + 1 + k
        starts[j] = ones[i] + 1
    rest = np.zeros(n, np.int64)
    for j in range(k):
        rest = (rest << 1) | bits[starts + j]
    return np.cumsum((delta << k) | rest)


def normalised(raw: bytes) -> bytes:
    """raw with each run of the six white-space bytes as one space."""
    words = raw.split()  # bytes.split() cuts at exactly these bytes
    if not words:
        return b" " if raw else b""
    out = b" ".join(words)
    if raw[0] in _SPACES:
        out = b" " + out
    return out + b" " if raw[-1] in _SPACES else out


def _fingerprinted(bits: int, owners: int):
    names = [c.split()[0] for c in _ROWS.split(", ")]
    schema = pa.schema(
        [("kind", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("owner", pa.int32()), ("rank", pa.int64()), ("twice", pa.bool_()),
         ("doc_id", pa.int64()), ("sha", pa.binary()), ("n", pa.int64()), ("k", pa.int32()), ("payload", pa.binary())]
    )

    def table(size: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[c], schema.field(c).type) if c in cols else pa.nulls(size, schema.field(c).type) for c in names], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids: list[int | None] = []
        shas: list[bytes] = []
        for batch in batches:
            ids += batch.column("doc_id").to_pylist()
            shas += [hashlib.sha256(normalised(x)).digest() for x in as_binary(batch.column("text")).to_pylist()]
        if not ids:
            return
        fp = (np.frombuffer(b"".join(shas), ">u8").reshape(-1, 4)[:, 0] >> np.uint64(64 - bits)).astype(np.int64)
        unique, inverse, count = np.unique(fp, return_inverse=True, return_counts=True)
        edges = -(-(np.arange(owners + 1, dtype=object) << bits) // owners)  # owner o has [edges[o], edges[o + 1])
        at = np.searchsorted(unique, np.array(edges[:-1], np.int64))
        owner = np.searchsorted(at, np.arange(len(unique)), "right") - 1
        rank = np.arange(len(unique)) - at[owner]
        yield table(
            len(ids), kind=["d"] * len(ids), part=np.full(len(ids), part), seq=np.arange(len(ids)), owner=owner[inverse],
            rank=rank[inverse], twice=count[inverse] > 1, doc_id=ids, sha=shas,
        )
        for o in np.unique(owner).tolist():
            mine = unique[owner == o] - int(edges[o])
            k, payload = golomb_encode(mine)
            yield table(1, kind=["x"], part=[part], owner=[o], n=[len(mine)], k=[k], payload=[payload])

    return run


_BITMAP = "part int, owner int, bitmap binary"


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each owner's fingerprints, the bitmaps of those that more than one partition sent; rows come sorted by owner."""
    held: list[dict] = []

    def answer() -> pa.RecordBatch:
        values = [golomb_decode(r["k"], r["payload"], r["n"]) for r in held]
        unique, count = np.unique(np.concatenate(values), return_counts=True)
        shared = unique[count > 1]
        maps = [np.packbits(np.isin(v, shared, assume_unique=True), bitorder="little").tobytes() for v in values]
        return pa.RecordBatch.from_pydict(
            {"part": pa.array([r["part"] for r in held], pa.int32()), "owner": pa.array([r["owner"] for r in held], pa.int32()), "bitmap": pa.array(maps, pa.binary())}
        )

    for batch in batches:
        for r in batch.to_pylist():
            if held and held[0]["owner"] != r["owner"]:
                yield answer()
                held = []
            held.append(r)
    if held:
        yield answer()


def exact_groups(documents: DataFrame) -> DataFrame:
    """One row per row of documents: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = max(1, rows.count())
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(62, n.bit_length() + EXTRA_BITS)
    all_rows = written(rows.mapInArrow(_fingerprinted(bits, owners), _ROWS), "fingerprints")
    sent = all_rows.filter("kind = 'x'").select("part", "owner", "n", "k", "payload")
    bitmaps = written(sent.repartition(owners, "owner").sortWithinPartitions("owner", "part").mapInArrow(_answered, _BITMAP), "bitmaps")
    docs = all_rows.filter("kind = 'd'").select("part", "seq", "owner", "rank", "twice", "doc_id", "sha")
    byte = F.conv(F.hex(F.expr("substring(bitmap, int(rank div 8) + 1, 1)")), 16, 10).cast("int")
    shared = byte.bitwiseAND(F.expr("shiftleft(1, int(rank % 8))")) != 0
    docs = join_small(docs, bitmaps, ["part", "owner"]).withColumn("suspect", F.col("twice") | F.coalesce(shared, F.lit(False)))
    docs = docs.select("part", "seq", "doc_id", "sha", "suspect")
    suspects = written(docs.filter("suspect"), "suspects")
    # byte verification: texts of suspects only, combined by their bytes before and after the shuffle
    ids = suspects.select(F.col("doc_id").alias("_id")).distinct()
    checked = join_small(rows, ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    texts = checked.select(_normal().alias("t")).groupBy("t").agg(F.count("*").alias("c")).select(F.unhex(F.sha2("t", 256)).alias("sha"))
    texts = texts.groupBy("sha").agg(F.count("*").alias("texts"))
    one = F.struct("doc_id", "part", "seq")
    classes = suspects.groupBy("sha").agg(F.min(one).alias("first"), F.count("*").alias("size")).filter("size > 1")
    alike = F.when(F.col("texts") == 1, F.col("size")).otherwise(F.raise_error(F.lit("two texts have one sha-256")).cast("long"))
    classes = written(classes.join(texts, "sha").select("sha", "first", alike.alias("size")), "classes")
    out = join_small(docs, classes, "sha")
    return out.select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | (F.struct("part", "seq") == F.struct("first.part", "first.seq"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicated(documents: DataFrame) -> DataFrame:
    """The rows of documents that stay, with all their columns."""
    groups = written(exact_groups(documents), "exact-groups")
    by_id = groups.groupBy("doc_id").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped")).filter("dropped > 0")
    by_id = written(by_id.select(F.col("doc_id").alias(_ID), "kept"), "dropped")
    same = F.col("doc_id").eqNullSafe(F.col(_ID))
    whole = join_small(documents, by_id.select(_ID), same, "left_anti")
    # a doc_id of which some rows stay and others go (repeated rows): one row for each kept text
    mixed = by_id.filter("kept > 0").select(_ID)
    if mixed.isEmpty():
        return whole
    stay = groups.filter("kept").select(F.col("doc_id").alias(_ID), F.col("text_sha256").alias(_SHA)).distinct()
    some = join_small(documents, mixed, same, "left_semi").withColumn(_OWN, F.sha2(_normal(), 256))
    some = some.dropDuplicates(["doc_id", _OWN])
    some = some.join(stay, same & (F.col(_OWN) == F.col(_SHA)), "left_semi").drop(_OWN)
    return whole.unionByName(some)
