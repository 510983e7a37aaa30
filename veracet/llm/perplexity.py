"""Quality rules by n-gram perplexity, with simple base rules before.

The model is a modified Kneser-Ney one over ``ORDER`` neighbouring bytes of a text's words, joined by single spaces and
otherwise unchanged; each language (the lang column) has two, one of each half of its documents (by a hash of the
text, so that copies share a half).  A document is scored by the model of the half where it isn't, so no text vouches for itself.

1. The n-grams of all documents are counted, in each partition first, then by a grouped sum, into sorted tables that
   grow with the corpus: a row for each language and n-gram with its count in either half.  An n-gram of five bytes is
   its own 64-bit code, so no two share a cell.
2. Order by order, in Spark: the counts of a lower order are the numbers of different bytes before it; totals of a context are
   window sums over its at most 256 n-grams; a probability is what discounts leave of the count, and the rest of the
   context's mass times the lower order's probability, joined by suffix.
3. The n-grams of a half with their bits by the other half's model are packed to sorted arrays of codes and bits, in rows
   of at most ``PACKED`` n-grams.  They are given to all tasks in shards of at most ``SHARD`` n-grams, and each shard's
   languages are read once for it; texts look their n-grams up by binary search, and the shards' sums are added.

A document has two scores, both logarithms of perplexities: its bits per byte, and its bits per word.  Each language's scores
are counted in bins over all documents that pass the base rules, and a score is rejected outside
[median - LOW_SPAN * (median - q10), median + HIGH_SPAN * (q90 - median)] in bits per byte (below is text that repeats
itself, above is noise), or above median + WORD_SPAN * (q90 - median) in bits per word (words salted with signs or mixed with
noise); no width counts as less than ``LEAST_WIDTH`` of the median.

Defined results: null text has no words and fails the base rules; a text of fewer than ORDER bytes has no score
and isn't rejected by the bands; null languages are one language; repeated rows count each; an empty table gives an empty
result; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracet.llm.store import binned_quantiles, join_small, written
from veracet.llm.words import Words, as_binary, mix, row_of, slices, split_words, spread

ORDER = 5
BINS = 200
#: Chosen from the scores of labelled documents of sf0.1 (README).
LOW_SPAN = 6.0
HIGH_SPAN = 12.0
WORD_SPAN = 4.0
LEAST_WIDTH = 0.02
MIN_WORDS = 50
#: N-grams that a task holds before it sends their counts on.
HELD = 2_000_000
#: N-grams of a packed row, and of a shard that all tasks are given (12 bytes each).
PACKED = 500_000
SHARD = 3_000_000
#: Positions of n-grams that are looked up at once; a code and a position fill 64 bits.
_AT_ONCE = 1 << (64 - 8 * ORDER)

_SYMBOL_SIGNS = np.zeros(256, bool)
_SYMBOL_SIGNS[list(b"#*$%&|<>")] = True


def codes(data: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The code of the n-gram that begins at each byte."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(order):
        out <<= np.uint64(8)
        out |= data[i : i + n]
    return out


def _extent(words: Words, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the range of n-grams that lie in its words."""
    some = np.diff(words.first) > 0
    begin = np.zeros(len(some), np.int64)
    end = np.zeros(len(some), np.int64)
    begin[some] = words.start[words.first[:-1][some]]
    end[some] = np.maximum(begin[some], words.end[words.first[1:][some] - 1] - order + 1)
    return begin, end


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[str, int, np.ndarray, pa.Array]]:
    """(language, half, rows, texts) of a batch, in slices."""
    column = as_binary(batch.column("text"))
    key = np.array([f"{half}{lang}" for lang, half in zip(batch.column("lang").to_pylist(), batch.column("half").to_pylist(), strict=True)], object)
    for k in sorted(set(key)):
        rows = np.flatnonzero(key == k)
        mine = column.take(pa.array(rows))
        for i, j in slices(mine):
            yield k[1:], int(k[0]), rows[i:j], mine.slice(i, j - i)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts, one row for each code, ascending."""
    code, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order]
    at = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    return code[at], np.add.reduceat(count, at) if len(at) else count


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    n_held = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, half), parts in held.items():
            code, count = _summed(parts)
            counts = [count, np.zeros_like(count)][:: -1 if half else 1]
            for a in range(0, len(code), 100_000):
                cols = [x[a : a + 100_000] for x in (code.view(np.int64), *counts)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cols[0]), pa.string()), *map(pa.array, cols)], ["lang", "code", "c0", "c1"])
        held.clear()

    for batch in batches:
        for lang, half, _, texts in _parts(batch):
            words = split_words(texts)
            begin, end = _extent(words, ORDER)
            code, count = np.unique(codes(words.data)[spread(begin, end - begin)], return_counts=True)
            parts = held.setdefault((lang, half), [])
            parts.append((code, count))
            n_held += len(code)
            if len(parts) >= 16:
                n_held -= sum(len(p[0]) for p in parts)
                parts[:] = [_summed(parts)]
                n_held += len(parts[0][0])
            if n_held > HELD:
                yield from sent()
                n_held = 0
    yield from sent()


def _halves(name: str) -> tuple[Column, Column]:
    return F.col(f"{name}0"), F.col(f"{name}1")


def discounts(level: DataFrame) -> DataFrame:
    """(lang, d10, d20, d30, d11, d21, d31): the modified Kneser-Ney discounts of counts 1, 2 and 3 or more, in either half."""
    n = level.groupBy("lang").agg(*[F.count_if(F.col(f"c{h}") == k).alias(f"n{k}{h}") for h in (0, 1) for k in (1, 2, 3, 4)])
    out = []
    for h in (0, 1):
        n1, n2, n3, n4 = (F.col(f"n{k}{h}") for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        known = (n1 > 0) & (n2 > 0) & (n3 > 0)
        given = ((1 - 2 * y * n2 / n1, 0.5, 0.95), (2 - 3 * y * n3 / n2, 0.75, 1.9), (3 - 4 * y * n4 / n3, 0.9, 2.9))
        out += [F.when(known, F.greatest(F.lit(0.05), F.least(F.lit(most), d))).otherwise(F.lit(usual)).alias(f"d{k}{h}") for k, (d, usual, most) in enumerate(given, 1)]
    return n.select("lang", *out)


def _probabilities(level: DataFrame, below: DataFrame | None, order: int) -> DataFrame:
    """(lang, code, c0, c1, p0, p1): of the last byte of each n-gram after the others, by the models of both halves."""
    rows = join_small(level, written(discounts(level), "discounts"), "lang", "inner").withColumn("_context", F.shiftright("code", 8))
    context = Window.partitionBy("lang", "_context")
    for h in (0, 1):
        c = F.col(f"c{h}")
        cut = F.when(c == 0, 0.0).when(c == 1, F.col(f"d1{h}")).when(c == 2, F.col(f"d2{h}")).otherwise(F.col(f"d3{h}"))
        rows = rows.withColumn(f"_cut{h}", cut)
    rows = rows.withColumns({f"_{x}{h}": F.sum(y + str(h)).over(context) for h in (0, 1) for x, y in (("total", "c"), ("left", "_cut"))})
    if below is None:
        rows = rows.withColumns({"_p0": F.lit(1 / 256), "_p1": F.lit(1 / 256)})
    else:
        below = below.select("lang", F.col("code").alias("_suffix"), F.col("p0").alias("_p0"), F.col("p1").alias("_p1"))
        rows = rows.withColumn("_suffix", F.col("code").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))).join(below, ["lang", "_suffix"])
    for h in (0, 1):
        total, lower = F.col(f"_total{h}"), F.col(f"_p{h}")
        rows = rows.withColumn(f"p{h}", F.when(total > 0, (F.col(f"c{h}") - F.col(f"_cut{h}") + F.col(f"_left{h}") * lower) / total).otherwise(lower))
    return written(rows.select("lang", "code", "c0", "c1", "p0", "p1"), f"order-{order}")


def train(documents: DataFrame, order: int = ORDER) -> DataFrame:
    """documents: text, lang (not null), half.  The probabilities of all n-grams, as ``_probabilities`` gives them."""
    counts = documents.select("text", "lang", "half").mapInArrow(_counted, "lang string, code long, c0 long, c1 long")
    levels = [written(counts.groupBy("lang", "code").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), "counts")]
    for n in range(order - 1, 0, -1):
        suffix = F.col("code").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("code")
        shorter = levels[-1].groupBy("lang", suffix).agg(F.count_if(F.col("c0") > 0).alias("c0"), F.count_if(F.col("c1") > 0).alias("c1"))
        levels.append(written(shorter, "counts"))
    out = None
    for n, level in enumerate(reversed(levels), 1):
        out = _probabilities(level, out, n)
    return out


_TABLE = "lang string, half int, n long, codes binary, bits binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows lang, half, code, bits, sorted so, to arrays."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    key, n = None, 0

    def table() -> pa.RecordBatch:
        code, bits = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([len(code)]), pa.array([code.astype("<u8").tobytes()]), pa.array([bits.astype("<f4").tobytes()])], ["lang", "half", "n", "codes", "bits"])

    for batch in batches:
        langs, halves = batch.column("lang").to_pylist(), batch.column("half").to_pylist()
        code, bits = batch.column("code").to_numpy(), batch.column("bits").to_numpy()
        at = [0, *[i for i in range(1, len(langs)) if (langs[i], halves[i]) != (langs[i - 1], halves[i - 1])], len(langs)]
        for i, j in zip(at[:-1], at[1:], strict=True):
            if i == j:
                continue
            if held and ((langs[i], halves[i]) != key or n + j - i > PACKED):
                yield table()
                n = 0
            key = (langs[i], halves[i])
            held.append((code[i:j], bits[i:j]))
            n += j - i
    if held:
        yield table()


def lookup_table(model: DataFrame) -> DataFrame:
    """The n-grams of each language and half, with their bits by the other half's model, as packed rows."""
    n = int(model.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = [model.filter(F.col(f"c{h}") > 0).select("lang", F.lit(h).alias("half"), "code", (-F.log2(f"p{1 - h}")).alias("bits")) for h in (0, 1)]
    rows = parts[0].unionByName(parts[1]).repartitionByRange(n, "lang", "half", "code").sortWithinPartitions("lang", "half", "code")
    return written(rows.mapInArrow(_packed, _TABLE), "lookup", rows=100_000)


def _shards(table: DataFrame, most: int) -> Iterator[tuple[list[str], dict]]:
    """(languages, arrays by language and half) of shards of at most ``most`` n-grams (or one packed row)."""
    names = table.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang")
    group: list[str] = []
    size = 0

    def read(langs: list[str], part: DataFrame) -> tuple[list[str], dict]:
        arrays: dict[tuple[str, int], list] = {}
        for r in part.collect():  # at most ``most`` n-grams of 12 bytes
            arrays.setdefault((r["lang"], r["half"]), []).append((bytes(r["codes"]), bytes(r["bits"])))
        return langs, arrays

    for r in names.toLocalIterator():
        if r["n"] > most:  # a language of its own shards: its packed rows, in turns
            turns = -(-r["n"] // max(1, most - PACKED)) if most > PACKED else -(-r["n"] // most)
            mine = table.filter(F.col("lang") == r["lang"])
            for k in range(turns):
                part = mine.filter(F.pmod(F.xxhash64("codes"), F.lit(turns)) == k)
                yield read([r["lang"]], part)
            continue
        if group and size + r["n"] > most:
            yield read(group, table.filter(F.col("lang").isin(group)))
            group, size = [], 0
        group.append(r["lang"])
        size += r["n"]
    if group:
        yield read(group, table.filter(F.col("lang").isin(group)))


def _base(words: Words, raw: list[bytes]) -> dict[str, np.ndarray]:
    n = np.diff(words.first)
    rows = len(n)
    total = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    begin, end = _extent(words, 1)
    inside = total((words.data & 0xC0 != 0x80) & (words.data != 0x20))
    signs = total(_SYMBOL_SIGNS[words.data])
    covered = np.zeros(len(words.start) + 1, np.int32)
    if len(words.start) >= 3:
        row = row_of(words.first)
        ok = np.flatnonzero(row[:-2] == row[2:])
        key = mix(words.hashes(3)[ok] ^ mix(row[ok].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        often = np.zeros(len(ok), bool)
        often[order[1:][same]] = often[order[:-1][same]] = True
        np.add.at(covered, ok[often], 1)
        np.add.at(covered, ok[often] + 3, -1)
    repeated = total(np.cumsum(covered[:-1]) > 0)
    twice = np.zeros(rows, np.int64)
    for r, text in enumerate(raw):
        lines = text.split(b"\n")
        if len(lines) > 1:
            some = [x for x in lines if x.strip()]
            twice[r] = len(some) - len(set(some))
    first = words.first
    return {
        "n_words": n, "word_chars": inside[end] - inside[begin], "n_symbols": signs[end] - signs[begin],
        "n_dup_lines": twice, "n_repeat_words": repeated[first[1:]] - repeated[first[:-1]],
    }


_FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_BASE = "doc_id long, text_hash long, lang string, " + ", ".join(f"{c} long" for c in _FIGURES)
_SUMS = "doc_id long, text_hash long, lang string, found long, bits double, n_grams long"


def _looked_up(code: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each code its bits (0 where no table has it), and whether one has."""
    bits, found = np.zeros(len(code)), np.zeros(len(code), bool)
    for a in range(0, len(code), _AT_ONCE):
        part = code[a : a + _AT_ONCE]
        order = np.sort(part << np.uint64(64 - 8 * ORDER) | np.arange(len(part), dtype=np.uint64))
        part, order = order >> np.uint64(64 - 8 * ORDER), (order & np.uint64(_AT_ONCE - 1)).astype(np.int64)
        at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        one, times = part[at], np.diff(np.append(at, len(part)))
        value, known = np.zeros(len(one)), np.zeros(len(one), bool)
        for keys, of in tables:
            i = np.minimum(np.searchsorted(keys, one), len(keys) - 1)
            here = keys[i] == one
            value[here], known[here] = of[i[here]], True
        bits[a + order], found[a + order] = np.repeat(value, times), np.repeat(known, times)
    return bits, found


def _scored(shard, figures: bool):
    """Rows doc_id, text_hash, text, lang, half to sums of bits over the n-grams that the shard has; with figures, to the base figures."""
    loaded: dict[tuple[str, int], list] = {}

    def tables(lang: str, half: int) -> list:
        if (lang, half) not in loaded:
            loaded[lang, half] = [(np.frombuffer(c, "<u8"), np.frombuffer(b, "<f4")) for c, b in shard.value.get((lang, half), [])]
        return loaded[lang, half]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, half, rows, texts in _parts(batch):
                words = split_words(texts)
                ids = [batch.column(c).take(pa.array(rows)) for c in ("doc_id", "text_hash", "lang")]
                if figures:
                    base = _base(words, texts.to_pylist())
                    yield pa.RecordBatch.from_arrays([*ids, *(pa.array(base[c].astype(np.int64)) for c in _FIGURES)], ["doc_id", "text_hash", "lang", *_FIGURES])
                    continue
                begin, end = _extent(words, ORDER)
                size = end - begin
                bits, found = _looked_up(codes(words.data)[spread(begin, size)], tables(lang, half))
                row = np.repeat(np.arange(len(rows)), size)
                sums = np.bincount(row, bits, len(rows)).astype(np.float64), np.bincount(row[found], minlength=len(rows))
                yield pa.RecordBatch.from_arrays([*ids, pa.array(sums[1]), pa.array(sums[0]), pa.array(size)], ["doc_id", "text_hash", "lang", "found", "bits", "n_grams"])

    return run


def bands(scores: DataFrame, low_span: float = LOW_SPAN, high_span: float = HIGH_SPAN, word_span: float = WORD_SPAN) -> DataFrame:
    """(lang, low, high, most): the bands of each language, of bits per byte and (most) bits per word."""
    shares = {"q10": 0.1, "q50": 0.5, "q90": 0.9}

    def high(span: float) -> Column:
        return F.col("q50") + span * F.greatest(F.col("q90") - F.col("q50"), LEAST_WIDTH * F.col("q50"))

    passed = scores.filter(~F.col("base_failed"))
    byte = binned_quantiles(passed, "lang", "bits_per_byte", shares, BINS)
    byte = byte.select("lang", (F.col("q50") - low_span * F.greatest(F.col("q50") - F.col("q10"), LEAST_WIDTH * F.col("q50"))).alias("low"), high(high_span).alias("high"))
    return byte.join(binned_quantiles(passed, "lang", "bits_per_word", shares, BINS).select("lang", high(word_span).alias("most")), "lang")


def scored(documents: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per document: doc_id, lang, the base figures, base_failed, bits_per_byte, bits_per_word."""
    spark = documents.sparkSession
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.pmod(F.xxhash64("text", F.lit(7)), F.lit(2)).cast("int").alias("half"),
    )
    table = lookup_table(train(rows))
    base = written(rows.mapInArrow(_scored(None, figures=True), _BASE), "figures")
    sums, passes = None, 0
    for langs, arrays in _shards(table, shard):
        given = spark.sparkContext.broadcast(arrays)
        part = written(rows.filter(F.col("lang").isin(langs)).mapInArrow(_scored(given, figures=False), _SUMS).dropDuplicates(["doc_id", "text_hash", "lang"]), "sums")
        given.unpersist()
        sums, passes = part if sums is None else sums.unionByName(part), passes + 1
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = base.withColumn("base_failed", failed)
    if sums is None:
        return base.withColumns({"bits_per_byte": F.lit(None).cast("double"), "bits_per_word": F.lit(None).cast("double")})
    sums = sums.groupBy("doc_id", "text_hash", "lang").agg(F.sum("bits").alias("_bits"), F.max("n_grams").alias("_n"))
    sums = sums.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("lang").alias("_l"), "_bits", F.nullif("_n", F.lit(0)).alias("_n"))
    out = base.join(sums, base["doc_id"].eqNullSafe(sums["_d"]) & (base["text_hash"] == sums["_h"]) & (base["lang"] == sums["_l"]), "left")
    out = out.withColumns({"bits_per_byte": F.col("_bits") / F.col("_n"), "bits_per_word": F.when(F.col("_n") > 0, F.col("_bits")) / F.nullif("n_words", F.lit(0))})
    return out.drop("_d", "_h", "_l", "_bits", "_n")


def judged(documents: DataFrame, shard: int = SHARD, low_span: float = LOW_SPAN, high_span: float = HIGH_SPAN, word_span: float = WORD_SPAN) -> DataFrame:
    """One row per document: doc_id, n_words, the base figures, base_failed, kept, lang, bits_per_byte and bits_per_word."""
    scores = written(scored(documents, shard), "scores")
    scores = join_small(scores, written(bands(scores, low_span, high_span, word_span), "bands"), "lang")
    byte, word = F.col("bits_per_byte"), F.col("bits_per_word")
    inside = F.coalesce((byte >= F.col("low")) & (byte <= F.col("high")) & (word <= F.col("most")), F.lit(True))
    return scores.select("doc_id", *_FIGURES, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "lang", "bits_per_byte", "bits_per_word")
