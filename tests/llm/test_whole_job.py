"""Cases in which an operator did less than its whole job."""

from __future__ import annotations

import random

import numpy as np
import pytest

from veracet.llm import link_trust, perplexity

DOCS = "doc_id long, text string, lang string"


def prose(rng: random.Random, words: int, parts: tuple[str, ...] = ("ba", "ne", "lo", "ti", "ra")) -> list[str]:
    return ["".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(words)]


def test_perplexity_rejects_salted_and_degenerate_text(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(prose(rng, 150)) + ".", "xx") for i in range(300)]
    rows += [(1000 + i, " ".join(w + rng.choice(["***", "%%%", "###", "$$$"]) for w in prose(rng, 150)), "xx") for i in range(12)]
    rows += [(2000 + i, " ".join("b" * rng.randint(5, 60) for _ in range(150)), "xx") for i in range(4)]  # low perplexity, hardly a repeated passage
    rows += [(3000 + i, " ".join("".join(rng.choices("qxzjkvw0183!", k=9)) for _ in range(80)), "xx") for i in range(4)]  # high
    rows += [(4000 + i, " ".join(prose(rng, 120) + prose(rng, 30, ("mu", "pe", "ki"))), "xx") for i in range(6)]  # two languages
    out = {r["doc_id"]: r for r in perplexity.judged(spark.createDataFrame(rows, DOCS)).collect()}
    assert not any(r["base_failed"] for r in out.values())
    assert [i for i, r in out.items() if not r["kept"] and (i < 1000 or i >= 4000)] == []
    assert [i for i, r in out.items() if r["kept"] and 1000 <= i < 4000] == []


def test_perplexity_rejects_shuffled_words_and_noise_in_every_language(spark):
    """Phrases in a fixed order stay; the same words in any order, and noise, go."""
    rng = random.Random(8)
    rows, bad = [], set()
    for k, lang in enumerate(["aa", "bb", "cc"]):
        letters = ("abcdefghijklm", "nopqrstuvwxyz", "aeioustrnlmdp")[k]
        words = ["".join(rng.choices(letters, k=rng.randint(2, 4))) for _ in range(200)]
        phrases = [rng.sample(words, 6) for _ in range(300)]
        for i in range(250):
            text = [w for phrase in rng.sample(phrases, 20) for w in phrase]
            rows.append((1000 * k + i, " ".join(text), lang))
        for i in range(250, 256):
            text = rng.choices(words, k=120)
            rows.append((1000 * k + i, " ".join(text), lang))
            bad.add(1000 * k + i)
        for i in range(256, 262):
            rows.append((1000 * k + i, " ".join("".join(rng.choices(letters + "0123456789", k=7)) for _ in range(90)), lang))
            bad.add(1000 * k + i)
    out = perplexity.judged(spark.createDataFrame(rows, DOCS)).collect()
    assert not any(r["base_failed"] for r in out)
    assert {r["doc_id"] for r in out if not r["kept"]} == bad


def test_every_linker_of_a_blocked_host_is_blocked(spark):
    bad, fine = '<a href="http://evil.net/x">x</a>', "".join(f'<a href="http://calm{i}.example/x">x</a>' for i in range(9))
    rows = [("http://evil.net/x", ""), *[(f"http://ring{i}.example/a", bad) for i in range(5)], ("http://hub.example/a", bad + fine), *[(f"http://calm{i}.example/a", "") for i in range(9)]]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r["host"]: r["verdict"] for r in link_trust.judged(pages).collect()}
    assert {h for h, v in got.items() if v == "block"} == {"evil.net", *[f"ring{i}.example" for i in range(5)]}


def test_propagation_goes_on_until_the_tolerance(spark):
    edges = [("a", "b", 1.0), ("b", "a", 1.0)]
    seeds = [("a", 1.0, 0.0), ("b", 0.0, 1.0)]
    got = {r["host"]: r for r in link_trust.propagated(spark.createDataFrame(edges, "source string, target string, weight double"), spark.createDataFrame(seeds, "host string, trust double, distrust double")).collect()}
    want = np.linalg.solve(np.eye(2) - 0.85 * np.array([[0, 1], [1, 0]]), [1, 0])
    assert [got["a"]["trust"], got["b"]["trust"]] == pytest.approx(want, abs=1e-5)
    assert [got["b"]["distrust"], got["a"]["distrust"]] == pytest.approx(want, abs=1e-5)
    assert [got["b"]["blame"], got["a"]["blame"]] == pytest.approx([1, 0.85], abs=1e-5)
