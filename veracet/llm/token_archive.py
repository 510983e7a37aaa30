"""Token-ID output: documents to an archive of statically rANS-coded blocks, and back.

An archive is a folder with two tables:

* ``table``: symbol, frequency (the one shared frequency table, counted over all documents);
* ``blocks``: shard, block, shard_start (tokens of the shard before the block), n_tokens, doc_ids and counts
  (its documents, in order) and payload (a block of ``rans``).

Documents lie in ascending doc_id order over shards and blocks; a document is never split over blocks, a block
has at least ``BLOCK_TOKENS`` tokens unless it ends its shard.  Null text counts as empty (one end token), equal
doc_ids keep all their rows (ordered by text, then equal), null doc_ids come first; an empty table gives an empty archive.
Columns other than doc_id and text are ignored.

The ids are tokenized once and kept as a table between counting and coding; a shard is one range of doc_id, so
no task holds more than a block besides its batch.  Collected: one row per symbol, one per shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracet.llm.rans import Table, decode_block, encode_block
from veracet.llm.store import drop, new_path
from veracet.llm.tokens import encoded, tokenizer_path
from veracet.llm.words import as_binary

BLOCK_TOKENS = 1 << 17
_BLOCK = "shard int, block int, shard_start long, n_tokens long, doc_ids array<long>, counts array<long>, payload binary"


def _tokenized(path: str, end_id: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        docs, counts, ids, held, block, start = [], [], [], 0, 0, 0
        seen = np.zeros(0, np.int64)

        def row(symbols: np.ndarray, totals: np.ndarray) -> pa.RecordBatch:
            payload = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            cols = [
                pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()),
                pa.array([held], pa.int64()), pa.array([[x for d in docs for x in d]], pa.list_(pa.int64())),
                pa.array([[x for c in counts for x in c]], pa.list_(pa.int64())),
                pa.array([payload.astype("<u4").tobytes()], pa.binary()),
                pa.array([symbols], pa.list_(pa.int64())), pa.array([totals], pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(cols, [*[c.split()[0] for c in _BLOCK.split(", ")], "symbols", "totals"])

        none: list[int] = []
        for batch in batches:
            column, doc_ids = as_binary(batch.column("text")), batch.column("doc_id").to_pylist()
            for a, b, got, count in encoded(column, path, end_id):
                seen = np.pad(seen, (0, max(0, int(got.max()) + 1 - len(seen))))
                seen[: int(got.max()) + 1] += np.bincount(got)
                docs.append(doc_ids[a:b])
                counts.append(count.tolist())
                ids.append(got)
                held += len(got)
                if held >= block_tokens:
                    yield row(none, none)
                    block, start, held = block + 1, start + held, 0
                    docs, counts, ids = [], [], []
        if held or len(seen):
            some = np.flatnonzero(seen)
            yield row(some.tolist(), seen[some].tolist())

    return run


def _coded(table: Table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("payload")
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                ids = np.frombuffer(one.column(at)[0].as_py(), "<u4")
                yield one.set_column(at, "payload", pa.array([encode_block(ids, table)], pa.binary()))

    return run


def write_archive(documents: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encodes every whole text, adds ``end_id`` and writes the archive at ``path``.

    tokenizer: a vocabulary file of the tokenizers library, by name (see ``tokens.FOLDER``) or path.
    """
    spark = documents.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vocabulary = tokenizer if "/" in tokenizer else tokenizer_path(tokenizer)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = f"{_BLOCK}, symbols array<long>, totals array<long>"
    between = new_path(spark, "ids")
    dealt.mapInArrow(_tokenized(vocabulary, end_id, block_tokens), schema).write.option("compression", "zstd").parquet(between)
    raw = spark.read.schema(schema).parquet(between)
    seen = raw.select(F.explode(F.arrays_zip("symbols", "totals")).alias("x")).groupBy("x.symbols").agg(F.sum("x.totals").alias("n"))
    seen = sorted((int(r[0]), int(r[1])) for r in seen.collect())  # at most one row per vocabulary entry
    if seen:
        symbols, counts = np.array(seen, np.int64).T
        table = Table.fitted(symbols, counts)
        made = [(int(s), int(f)) for s, f in zip(table.symbols, table.frequency, strict=True)]
    else:
        made, table = [], Table(np.zeros(1), np.ones(1))
    spark.createDataFrame(made, "symbol long, frequency long").coalesce(1).write.parquet(f"{path}/table")
    blocks = raw.filter("n_tokens > 0").select(*[c.split()[0] for c in _BLOCK.split(", ")])
    blocks.mapInArrow(_coded(table), _BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")
    drop(spark, between)


def read_table(spark: SparkSession, path: str) -> Table:
    rows = sorted((r[0], r[1]) for r in spark.read.schema("symbol long, frequency long").parquet(f"{path}/table").collect())
    return Table(*np.array(rows, np.int64).T) if rows else Table(np.zeros(1), np.ones(1))


def _decoded(table: Table, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                ids = np.ascontiguousarray(decode_block(r["payload"], table), "<u4")
                count = np.array(r["counts"], np.int64)
                if len(ids) != r["n_tokens"] or count.sum() != len(ids):
                    raise ValueError(f"shard {r['shard']}, block {r['block']}: counts and ids differ")
                end = np.cumsum(count)
                parts = [ids[a:b] for a, b in zip((end - count).tolist(), end.tolist(), strict=True)]
                cols = {
                    "shard": pa.array(np.full(len(count), r["shard"], np.int32)), "doc_id": pa.array(r["doc_ids"], pa.int64()),
                    "shard_start": pa.array(r["shard_start"] + end - count), "n_tokens": pa.array(count),
                    "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                }
                if with_ids:
                    cols["ids"] = pa.array([p.tobytes() for p in parts], pa.binary())
                yield pa.RecordBatch.from_pydict(cols)

    return run


def read_archive(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, ids (u32 binary)."""
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    base, bases = 0, []
    for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():  # one row per shard
        bases.append((r[0], base))
        base += r[1]
    bases = spark.createDataFrame(bases, "shard int, base long")
    schema = "shard int, doc_id long, shard_start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    docs = blocks.mapInArrow(_decoded(read_table(spark, path), with_ids), schema)
    docs = docs.join(F.broadcast(bases), "shard").withColumn("start", F.col("base") + F.col("shard_start"))
    return docs.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)
