"""Language identification by Bayesian evidence fusion.

Four kinds of evidence on a document's language are multiplied:

* its text: trigrams of bytes (A-Z in lower case), hashed to ``CELLS`` cells, with smoothed frequencies for each
  language.  They are fitted on the at most ``SAMPLE`` labelled rows with the smallest hash of doc_id; every text
  is scored whole.  As neighbouring trigrams depend on each other, a text counts as ``EVIDENCE`` of them at most;
* the language that its markup declares (or its row): right with ``DECLARED``, else any other;
* the suffix of its address, for suffixes that stand for one language: right with ``SUFFIX``;
* a prior by host, smoothed through its domain to the whole corpus: each level's expected counts of languages
  (sums of what the texts alone say, by grouped aggregation) plus ``PRIOR`` times the level above.

A document's language is the most probable one.  It is rejected if it has no trigram, its probability is below ``LEAST``, a
language that its row claims (a label, which is no evidence) has a probability below ``DENIED``, or it is in none of the known
languages: its cost (bits per trigram in its likeliest language) is above the median of that language's texts by more than
``SPAN`` times the width from the median to the ninth decile (counted in bins over all texts), where a short text is
allowed more, as its cost varies more.

The texts of pages are read without their markup, scripts and styles.

Defined results: null text has no trigram and is rejected; null or unknown declarations and suffixes say nothing;
null hosts are one host; ties go to the language first by code point; repeated rows are judged alike; with no labelled
row, or an empty table, nothing is kept; other columns are ignored (and kept by ``kept_documents``).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracet.llm.link_trust import host_of
from veracet.llm.store import BROADCAST_ROWS, binned_quantiles, join_small, written
from veracet.llm.words import LOWER, as_binary, joined, slices

CELLS = 1 << 16
SAMPLE = 20_000
EVIDENCE = 60.0
DECLARED = 0.9
SUFFIX = 0.8
PRIOR = 20.0
LEAST = 0.5
DENIED = 1e-9
SPAN = 5.0
#: Address suffixes that stand for one language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en", "it": "it", "pt": "pt", "nl": "nl"}
BINS = 200
_MARKUP = re.compile(rb"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>", re.I | re.S)
_LANG = re.compile(rb"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-zA-Z]{2,3})\b", re.I)


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The cells of the trigrams that begin in each byte of the texts (a line feed after each), and the rows' offsets.

    Rows of runs of digits, signs and spaces alone say nothing: a trigram counts if it has a letter (else cell -1)."""
    data, offsets = joined(column)
    data = LOWER[data].astype(np.int32)
    letter = ((data >= 97) & (data <= 122)) | (data >= 0x80)
    n = max(0, len(data) - 2)
    cell = (data[:n] * 961 + data[1 : n + 1] * 31 + data[2 : n + 2]) * 40503 % CELLS
    cell[~(letter[:n] | letter[1 : n + 1] | letter[2 : n + 2])] = -1
    cell = np.concatenate((cell, np.full(len(data) - n, -1, cell.dtype)))
    for back in (1, 2):  # none runs into the next row
        cell[np.maximum(offsets[1:] - back, offsets[:-1])] = -1
    return cell, offsets


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        column, langs = as_binary(batch.column("text")), np.array(batch.column("label").to_pylist(), object)
        for i, j in slices(column):
            cell, offsets = trigrams(column.slice(i, j - i))
            row = np.repeat(np.arange(j - i), np.diff(offsets))
            for lang in set(langs[i:j]):
                mine = (langs[i:j] == lang)[row] & (cell >= 0)
                held[lang] = held.get(lang, 0) + np.bincount(cell[mine], minlength=CELLS)
    for lang, count in held.items():
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"label": pa.array([lang] * len(some), pa.string()), "cell": pa.array(some.astype(np.int32)), "n": pa.array(count[some].astype(np.int64))})


def train(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """labelled: doc_id, text, label.  Languages in order, and the log frequency of each cell in each."""
    rows = labelled.filter("label is not null and text is not null").withColumn("_h", F.xxhash64("doc_id"))
    last = rows.select("_h").orderBy("_h").limit(sample).agg(F.max("_h")).first()[0]
    if last is None:
        return [], np.zeros((CELLS, 0), np.float32)
    counts = rows.filter(F.col("_h") <= last).select("text", "label").mapInArrow(_counted, "label string, cell int, n long")
    counts = counts.groupBy("label", "cell").agg(F.sum("n").alias("n")).toPandas()  # at most CELLS rows a language
    languages = sorted(set(counts["label"]), key=lambda x: x.encode())
    table = np.full((CELLS, len(languages)), 0.5)
    for k, lang in enumerate(languages):
        mine = counts[counts["label"] == lang]
        table[mine["cell"].to_numpy(), k] += mine["n"].to_numpy()
    return languages, np.log(table / table.sum(0)).astype(np.float32)


def _scored(table: np.ndarray, evidence: float, html: bool):
    """Of each row the log likelihoods of its text (as of ``evidence`` trigrams at most), and its cost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = as_binary(batch.column("text"))
            for i, j in slices(column):
                part = column.slice(i, j - i)
                declared = batch.column("declared").slice(i, j - i)
                if html:
                    raw = part.to_pylist()
                    said = [m[1].decode().lower() if (m := _LANG.search(t)) else None for t in raw]
                    declared = pa.array([a or b for a, b in zip(declared.to_pylist(), said, strict=True)], pa.string())
                    part = pa.array([_MARKUP.sub(b" ", t) for t in raw], pa.large_binary())
                cell, offsets = trigrams(part)
                n = np.diff(np.concatenate(([0], np.cumsum(cell >= 0)))[offsets])
                log = np.empty((j - i, table.shape[1]))
                for k in range(table.shape[1]):
                    sums = np.concatenate(([0.0], np.cumsum(np.where(cell >= 0, table[:, k][cell], 0), dtype=np.float64)))[offsets]
                    log[:, k] = np.diff(sums)
                cost = np.where(n > 0, -log.max(axis=1) / np.maximum(n, 1) / np.log(2), 0.0)
                log *= np.minimum(1.0, evidence / np.maximum(n, 1))[:, None]
                cols = [batch.column(c).slice(i, j - i) for c in ("doc_id", "text_hash", "host", "claimed")]
                rows = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * table.shape[1], pa.int32()), pa.array(log.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*cols, declared, pa.array(n), pa.array(cost), rows], ["doc_id", "text_hash", "host", "claimed", "declared", "n", "cost", "log"])

    return run


def _normalised(log: Column) -> Column:
    """Logarithms to probabilities."""
    up = F.transform(log, lambda x: F.exp(x - F.array_max(log)))
    return F.transform(up, lambda x: x / F.aggregate(up, F.lit(0.0), lambda a, b: a + b))


def _domain(host: Column) -> Column:
    return F.when(host.contains("."), F.substring_index(host, ".", -2)).otherwise(host)


def _level(scores: DataFrame, key: str, size: int) -> DataFrame:
    """(key, n, counts): expected counts of the languages, summed by key."""
    sums = [F.sum(F.col("p")[k]).alias(f"c{k}") for k in range(size)]
    out = scores.groupBy(key).agg(F.count("*").cast("double").alias("n"), *sums)
    return out.select(key, "n", F.array(*[f"c{k}" for k in range(size)]).alias("counts"))


def _smoothed(counts: str, n: str, above: Column, weight: float) -> Column:
    return F.transform(F.arrays_zip(F.col(counts).alias("c"), above.alias("a")), lambda x: (x["c"] + weight * x["a"]) / (F.col(n) + weight))


def _tag(column: Column) -> Column:
    """The language of a language tag: de of de-AT or DE_de."""
    return F.lower(F.substring_index(F.translate(F.trim(column), "_", "-"), "-", 1))


def identified(
    rows: DataFrame, languages: list[str], table: np.ndarray, evidence: float = EVIDENCE, declared_right: float = DECLARED, suffix_right: float = SUFFIX, prior: float = PRIOR,
    least: float = LEAST, denied: float = DENIED, span: float = SPAN, html: bool = False,
) -> DataFrame:
    """rows: doc_id, text, declared, host, claimed.  One row each: doc_id, text_hash, lang (null if nothing says one),
    probability, text_lang (by the text alone), cost, kept."""
    size = len(languages)
    rows = rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.lower(F.col("host")), F.lit("")).alias("host"),
        _tag(F.col("declared")).alias("declared"), _tag(F.col("claimed")).alias("claimed"), "text",
    )
    if not size:
        none = F.lit(None)
        return rows.select("doc_id", "text_hash", none.cast("string").alias("lang"), F.lit(0.0).alias("probability"), none.cast("string").alias("text_lang"), none.cast("double").alias("cost"), F.lit(False).alias("kept"))
    names = F.array(*map(F.lit, languages))
    best = lambda p: F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))
    schema = "doc_id long, text_hash long, host string, claimed string, declared string, n long, cost double, log array<double>"
    scores = rows.mapInArrow(_scored(table, evidence, html), schema)
    scores = scores.withColumn("p", _normalised(F.col("log"))).withColumn("domain", _domain(F.col("host"))).withColumn("text_lang", F.when(F.col("n") > 0, best(F.col("p"))))
    scores = written(scores, "language-scores")
    spoken = scores.filter("n > 0")
    whole = spoken.agg(F.count("*"), *[F.sum(F.col("p")[k]) for k in range(size)]).first()
    overall = [(float(whole[1 + k] or 0) + 1.0) / (float(whole[0]) + size) for k in range(size)]
    domains = _level(spoken, "domain", size)
    domains = written(domains.select("domain", _smoothed("counts", "n", F.array(*map(F.lit, overall)), prior).alias("above")), "domains")
    hosts = _level(spoken, "host", size).withColumn("domain", _domain(F.col("host")))
    hosts = join_small(hosts, domains, "domain")
    hosts = written(hosts.select("host", _smoothed("counts", "n", F.col("above"), prior).alias("prior")), "hosts")
    costs = written(binned_quantiles(spoken.filter(F.col("n") >= evidence), "text_lang", "cost", {"_q5": 0.5, "_q9": 0.9}, BINS), "costs")

    def says(column: Column, right: float) -> Column:
        """Log evidence of a statement for each language."""
        known = F.coalesce(column.isin(languages), F.lit(False))
        other = math.log((1 - right) / max(1, size - 1)) if size > 1 else 0.0
        return F.array(*[F.when(~known, 0.0).when(column == lang, math.log(right)).otherwise(other) for lang in languages])

    suffix = F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv]), F.substring_index("host", ".", -1))
    suffix = F.when(F.col("host").contains("."), suffix)
    out = join_small(join_small(scores, hosts, "host"), costs, "text_lang")
    prior_of = F.coalesce("prior", F.array(*map(F.lit, overall)))
    parts = F.arrays_zip(F.col("log").alias("t"), says(F.col("declared"), declared_right).alias("d"), says(suffix, suffix_right).alias("s"), prior_of.alias("p"))
    out = out.withColumn("post", _normalised(F.transform(parts, lambda x: x["t"] + x["d"] + x["s"] + F.log(x["p"]))))
    probability = F.array_max("post")
    claim = F.coalesce(F.element_at("post", F.nullif(F.array_position(names, F.col("claimed")), F.lit(0)).cast("int")), F.lit(1.0))
    width = F.greatest(F.col("_q9") - F.col("_q5"), 0.02 * F.col("_q5")) * (1 + F.sqrt(evidence / F.greatest("n", F.lit(1))))
    foreign = F.coalesce(F.col("cost") > F.col("_q5") + span * width, F.lit(False))
    kept = (F.col("n") > 0) & (probability >= least) & (claim >= denied) & ~foreign
    return out.select("doc_id", "text_hash", best(F.col("post")).alias("lang"), probability.alias("probability"), "text_lang", "cost", kept.alias("kept"))


def identify_documents(documents: DataFrame, **options) -> DataFrame:
    """``identified`` for a table of documents: lang is the label that the likelihoods are fitted on, and what a row claims, but no
    evidence on its own row; the source is the host."""
    languages, table = train(documents.select("doc_id", "text", _tag(F.col("lang")).alias("label")))
    none = F.lit(None).cast("string")
    return identified(documents.select("doc_id", "text", none.alias("declared"), F.col("source").alias("host"), F.col("lang").alias("claimed")), languages, table, **options)


def identify_pages(pages: DataFrame, documents: DataFrame, **options) -> DataFrame:
    """``identified`` for a table of pages (doc_id is the page's), by likelihoods fitted on documents: the markup's language, the
    address's suffix and the host are evidence."""
    languages, table = train(documents.select("doc_id", "text", _tag(F.col("lang")).alias("label")))
    none = F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), none.alias("declared"), host_of().alias("host"), none.alias("claimed"))
    return identified(rows, languages, table, html=True, **options)


def kept_documents(documents: DataFrame) -> DataFrame:
    """The documents that language identification doesn't reject."""
    out = written(identify_documents(documents).filter(~F.col("kept")).select(F.col("doc_id").alias("__veracet_id"), F.col("text_hash").alias("__veracet_h")).distinct(), "rejected")
    same = F.col("doc_id").eqNullSafe(F.col("__veracet_id")) & (F.xxhash64("text") == F.col("__veracet_h"))
    return join_small(documents, out, same, "left_anti", BROADCAST_ROWS)
