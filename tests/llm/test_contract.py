"""Each operator against a plain computation on a small table with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veracet.llm import exact_dedup, language, link_trust, mixing, near_dup, packing, perplexity, store, substring_dedup, templates, token_archive
from veracet.llm.tokens import ChunkTokenizer, tokenizer_path
from veracet.llm.words import as_binary

FUSED = "doc_id long, text string, declared string, host string"
FIELDS = "doc_id long, text string, lang string, source string, n_chars long, kind string, _id int"  # extra columns with clashing names
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus(n: int = 60, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéß日", k=rng.randint(1, 7))) for _ in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(1, 300))
        if i % 5 == 0 and texts:
            words = rng.choice([t for t in texts if t]).split()
            if i % 10 == 0:
                words[rng.randrange(len(words))] = "changed"
        text = rng.choice([" ", "  ", "\n", "\t "]).join(words)
        texts.append(f"{text}\n{passage} {i}" if i % 7 == 0 else text)
    texts += [None, "", "   ", " lead", "one two three", "ONE two THREE", "x" * 30_000, "a " * 500, "a " * 500, "#$%& <|endoftext|> it's\u00a0a\u2003b"]
    rows = [(i, t, ["en", "de", None][i % 3], [f"s{i % 4}", None, "big"][i % 3], None if t is None else len(t), "k", i) for i, t in enumerate(texts)]
    return [*rows, rows[1], rows[4], (None, texts[2], "en", "big", 1, "k", 0)]  # repeated rows, and no id


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), FIELDS).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], FIELDS)


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, str(r)))


def words_of(text):
    return WORD.findall((text or "").encode())


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def ids_of(name, text, end):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunked_ids_are_the_librarys(name):
    import pyarrow as pa

    texts = [r[1] for r in corpus(200)] + ["", "a  b", "\n\nx y \n", "x\r\n\ty'll don't 123 4,5", "é́ \u0301x", "don't! 'sx it's!'s ''ll a1b2 É×÷ ªº", "<|ENDOFTEXT|><|endoftext|>", "a\u0085b\x1cc"]
    got, count = ChunkTokenizer(tokenizer_path(name)).encode(as_binary(pa.array(texts, pa.string())))
    want = [ids_of(name, t, 0)[:-1] for t in texts]
    assert count.tolist() == list(map(len, want))
    assert got.tolist() == [i for w in want for i in w]


def test_chunks_with_one_hash_are_told_apart(monkeypatch):
    import pyarrow as pa

    from veracet.llm import tokens

    real = tokens.range_hash
    monkeypatch.setattr(tokens, "range_hash", lambda *args: real(*args) % np.uint64(50))
    tokenizer = ChunkTokenizer(tokenizer_path("word_bpe_49k.json"))
    for texts in (["one", "two"], ["the quick brown fox jumps over the lazy dog and many other words " * 3], ["three four", "", "one two five"]):
        got, count = tokenizer.encode(as_binary(pa.array(texts)))
        want = [ids_of("word_bpe_49k.json", t, 0)[:-1] for t in texts]
        assert count.tolist() == list(map(len, want))
        assert got.tolist() == [i for w in want for i in w]


def test_token_archive(spark, docs, empty, tmp_path):
    path = str(tmp_path / "archive")
    token_archive.write_archive(docs, path, block_tokens=2000)
    rows = token_archive.read_archive(spark, path, with_ids=True).orderBy("start").collect()
    want = [(r["doc_id"], ids_of("byte_bpe_50k.json", r["text"], 2)) for r in docs.collect()]
    assert sorted((r["doc_id"] or -1, np.frombuffer(r["ids"], "<u4").tolist()) for r in rows) == sorted((d or -1, w) for d, w in want)
    assert [r["start"] for r in rows] == list(np.cumsum([0, *[r["n_tokens"] for r in rows]])[:-1])
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in rows)
    token_archive.write_archive(empty, str(tmp_path / "none"))
    assert token_archive.read_archive(spark, str(tmp_path / "none")).collect() == []


def test_language(spark, docs, empty):
    out = language.identify_documents(docs).collect()
    assert len(out) == docs.count()
    assert {r["doc_id"] for r in out if not r["kept"]} >= {r["doc_id"] for r in docs.collect() if not words_of(r["text"])}
    assert language.kept_documents(docs).columns == docs.columns
    assert language.identify_documents(empty).collect() == []


def test_language_on_held_out_text_and_evidence(spark):
    rng = random.Random(1)
    stock = {"en": "the and of that with this from which there".split(), "de": "der und nicht eine über für auch sich werden".split(), "fr": "le être que pour dans une avec qui très".split()}
    made = [(i, " ".join(rng.choices(stock[k], k=30)), k) for i, k in enumerate(["en", "de", "fr"] * 40)]
    languages, table = language.train(spark.createDataFrame(made[:60], "doc_id long, text string, label string"))
    rows = [(i, t, None, "h.org") for i, t, _ in made[60:]] + [(900, "xyz", "de-AT", "h.org"), (901, "xyz", None, "a.fr"), (902, None, "de", "h.org"), (903, "xyz", "zz", None)]
    got = {r["doc_id"]: r for r in language.identified(spark.createDataFrame(rows, FUSED).withColumn("claimed", F.lit(None)), languages, table).collect()}
    assert all(got[i]["lang"] == k for i, _, k in made[60:])
    assert got[900]["lang"] == "de"
    assert not got[902]["kept"]
    html = [(1, '<html lang="fr"><p>xyz</p></html>', None, None)]
    out = language.identified(spark.createDataFrame(html, FUSED).withColumn("claimed", F.lit(None)), languages, table, html=True).first()
    assert out["lang"] == "fr"


def test_language_posterior_is_bayes(spark):
    """Against the product of likelihoods, statements and priors, with the priors smoothed host by domain by corpus."""
    rng = random.Random(3)
    stock = {"en": "the and of that with".split(), "de": "der und nicht eine auch".split()}
    made = [(i, " ".join(rng.choices(stock[k], k=30)), k) for i, k in enumerate(["en", "de"] * 20)]
    languages, table = language.train(spark.createDataFrame(made, "doc_id long, text string, label string"))
    rows = []
    for i in range(30):
        words = [*rng.choices(stock["en"], k=2), *rng.choices(stock["de"], k=rng.choice([0, 2, 4]))]
        rows.append((i, " ".join(words), rng.choice([None, "de", "en-GB", "xx"]), rng.choice(["a.h.de", "b.h.de", "h.com", "x.h.com", None])))
    got = {r["doc_id"]: r for r in language.identified(spark.createDataFrame(rows, FUSED).withColumn("claimed", F.lit(None)), languages, table).collect()}
    log = {}
    for i, text, *_ in rows:
        import pyarrow as pa

        cell, _ = language.trigrams(as_binary(pa.array([text])))
        sums = table[cell[cell >= 0]].astype(float).sum(0)
        log[i] = sums * min(1, language.EVIDENCE / (cell >= 0).sum())
    alone = {i: np.exp(v - v.max()) / np.exp(v - v.max()).sum() for i, v in log.items()}
    domain = lambda h: ".".join(h.split(".")[-2:])
    hosts = {i: h or "" for i, _, _, h in rows}
    whole = (sum(alone.values()) + 1) / (len(rows) + 2)
    for i, _, declared, host in rows:
        near = [alone[k] for k in alone if domain(hosts[k]) == domain(hosts[i])]
        above = (sum(near) + language.PRIOR * whole) / (len(near) + language.PRIOR)
        here = [alone[k] for k in alone if hosts[k] == hosts[i]]
        prior = (sum(here) + language.PRIOR * above) / (len(here) + language.PRIOR)
        post = log[i] + np.log(prior)
        if declared in ("de", "en-GB"):
            post = post + np.log([0.9 if declared[:2] == k else 0.1 for k in languages])
        if (host or "").endswith(".de"):
            post = post + np.log([0.8 if k == "de" else 0.2 for k in languages])
        post = np.exp(post - post.max()) / np.exp(post - post.max()).sum()
        assert got[i]["probability"] == pytest.approx(post.max(), abs=1e-6)
        assert got[i]["lang"] == languages[int(post.argmax())]
    assert any(r["lang"] != r["text_lang"] for r in got.values())


def test_language_rejects_what_fits_none_or_belies_its_label(spark):
    rng = random.Random(5)
    parts = {"en": "the an of ing tion er and st".split(), "fr": "le eau ou de que ment ai".split()}
    word = lambda k: "".join(rng.choices(parts[k], k=rng.randint(1, 3)))
    rows = [(i, " ".join(word(k) for _ in range(rng.randint(10, 150))), k, f"s{i % 3}") for i, k in enumerate(["en", "fr"] * 150)]
    rows += [(1000 + i, " ".join("".join(rng.choices("qxzjkvw", k=6)) for _ in range(40)), "en", "s1") for i in range(4)]  # junk
    rows += [(2000 + i, " ".join("".join(rng.choices("абвгдежз", k=6)) for _ in range(40)), "en", "s1") for i in range(4)]  # another language
    rows += [(3000 + i, " ".join(word("fr") for _ in range(80)), "en", "s1") for i in range(4)]  # another label
    rows += [(4000 + i, " ".join([*(word("fr") for _ in range(12)), *(word("en") for _ in range(70))]), "en", "s1") for i in range(4)]  # two languages
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"p": F.lit(1), "prior": F.lit("x"), "n": F.lit(None), "declared": F.lit("fr")})
    kept = language.kept_documents(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows if r[0] < 1000 or r[0] >= 4000}


def test_url_rules_and_parts(spark):
    urls = ["HTTP://Sub.Example.NET/en/1", "http://x.net/", "http://x.net", "https://example.com/de/2?q#f", "http://a.org/fr/x", "http://notexample.com/de/", "x", None, "a://b://c/d", "http://H?x/y"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in link_trust.judged(pages).collect()}
    assert got[0] == ("sub.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("x.net", "/", "net/", "block")
    assert got[2][:3] == ("x.net", "", None)
    assert got[3] == ("example.com", "/de/2", "example.com/de/", "block")
    assert got[4] == ("a.org", "/fr/x", "org/fr/", "allow")
    assert got[5] == ("notexample.com", "/de/", None, "allow")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8][:2] == ("b:", "//c/d")
    assert got[9][:2] == ("h", "")
    assert link_trust.judged(pages.limit(0)).collect() == []


def test_propagation_equals_power_iteration(spark):
    rng = np.random.default_rng(5)
    n = 12
    weight = rng.integers(0, 3, (n, n)) * (1 - np.eye(n, dtype=int))
    edges = [(f"h{i}", f"h{j}", float(weight[i, j])) for i in range(n) for j in range(n) if weight[i, j]]
    seeds = [(f"h{i}", float(i == 0), float(i == 1)) for i in range(n)]
    got = {r["host"]: r for r in link_trust.propagated(spark.createDataFrame(edges, "source string, target string, weight double"), spark.createDataFrame(seeds, "host string, trust double, distrust double"), rounds=8, tolerance=0).collect()}
    out, into = weight / np.maximum(weight.sum(1, keepdims=True), 1), weight / np.maximum(weight.sum(0, keepdims=True), 1)
    t0, d0 = np.eye(n)[0], np.eye(n)[1]
    t, d = t0, d0
    for _ in range(8):
        t, d = t0 + 0.85 * out.T @ t, d0 + 0.85 * into @ d
    assert [got[f"h{i}"]["trust"] for i in range(n)] == pytest.approx(t)
    assert [got[f"h{i}"]["distrust"] for i in range(n)] == pytest.approx(d)


def test_distrust_blocks_who_links_to_blocked(spark):
    bad = '<a href="http://evil.net/x">x</a>'
    pages = spark.createDataFrame([(1, "http://evil.net/x", ""), (2, "http://ring.example/a", bad), (3, "http://calm.example/a", "<a href='/x'>")], "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in link_trust.judged(pages).collect()} == {1: "block", 2: "block", 3: "allow"}


def test_main_text(spark):
    notice = '<div><p>We use cookies on this site.</p></div>'
    rows = [(i, "http://h.org/", f"<html><body><nav>menu {i}</nav>{notice}<div class='post'><h1>T{i}</h1><p>A&amp;B\n  {i}<br>c<p>open <b>bold {i}</b></div><aside>x</aside><div id='comments'><p>me</p></div></body></html>") for i in range(12)]
    rows += [(20, "http://h.org/2", None), (21, None, ""), (22, "u", "plain &lt;text"), (23, "u", "<article><p>one<ul><li>two<li>three</ul><script>if (a<b) {}</script></article><footer>f</footer>"), (24, "u", "<p>a</div></p>b<!-- c -->")]
    rows.append(rows[0])
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in templates.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        text = f"T{i}\nA&B {i} c\nopen bold {i}"
        assert got[i] == (text, len(text))  # the notice is no article's: it recurs on the site
    assert got[20] == got[21] == ("", 0)
    assert got[22][0] == "plain <text"
    assert got[23][0] == "one\ntwo\nthree"
    assert got[24][0] == "a\nb"


def test_text_beside_words_of_the_lists_stays():
    assert templates.extract('<article class="post comments-open"><p>a</p></article>') == "a"
    assert templates.extract('<article class="comments"><p>a</p></article>') == "a"
    assert templates.extract('<div id="content-with-sidebar"><p>a</p></div>') == "a"
    assert templates.extract('<article><div class="entry-header"><h1>a</h1></div><p class="lead notice">b</p></article>') == "a\nb"
    assert templates.extract('<form><div class="widget"><main><p>a</p></main></div></form>') == "a"
    assert templates.extract('<article><p>a</p></article><div class="comments"><article><p>me too</p></article></div>') == "a"
    assert templates.extract('<article><p>a</p><div class="ad">buy</div><div id="comments">x</div></article>') == "a"


def test_templates_are_counted_in_the_whole_tree(spark):
    """Spark's counts against plain ones, and a run in which templates change the texts."""
    rng = random.Random(4)
    rows = []
    for i in range(60):
        host = f"h{i % 3}.org"
        notice = f"<div class='box notice-line'><p>Read our terms, {host}.</p></div>" if i % 2 else ""
        own = "".join(f"<p>{' '.join(rng.choices('abcdefgh', k=6))} {i} {k}</p>" for k in range(3))
        rows.append((i, f"http://{host}/x", f"<body><ul class='links'><li>home</li><li>about</li></ul><div>{own}</div>{notice}</body>"))
    rows += [(100, "http://small.org/a", rows[1][2]), (101, None, None), (102, "http://h1.org/", "<div>" * 30_000 + "deep"), (103, "http://h1.org/", "<p>" + "long " * 200_000), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "templates": F.lit(1), "subtrees": F.lit("y")})
    on, seen = collections.defaultdict(set), collections.defaultdict(set)
    for _, url, html in rows:
        host, root = (url or "").removeprefix("http://").split("/")[0], templates.parse(html or "")
        article = tuple(templates._walk(templates.content(root), None)[1])
        seen[host].add(article)
        for h in templates._walk([root], None, whole=True)[1]:
            on[host, h].add(article)
    want = collections.defaultdict(list)
    for (host, h), articles in on.items():
        if len(articles) >= templates.LEAST_PAGES and len(articles) >= templates.LEAST_SHARE * len(seen[host]):
            want[host].append(h)
    got = {r["host"]: r["templates"] for r in templates.site_templates(pages).collect()}
    assert got == {h: sorted(t) for h, t in want.items()}
    texts = {r["page_id"]: r["text"] for r in templates.main_text(pages).collect()}
    assert all("terms" not in texts[i] and "home" not in texts[i] and len(texts[i].split("\n")) == 3 for i in range(60))
    assert "home" in texts[100] and texts[101] == "" and texts[102] == "deep" and texts[103] == ("long " * 200_000).strip()
    assert templates.main_text(pages.limit(0)).collect() == []


def test_page_copies_are_not_templates(spark):
    page = "<article><p>The same story.</p><p>Told again.</p></article>"
    rows = [(i, "http://h.org/", page) for i in range(40)]
    got = templates.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"The same story.\nTold again."}


@pytest.mark.parametrize(("bucket_rows", "large"), [(50_000, 1000), (50_000, 0), (2, 1000)])
def test_substring_dedup(docs, empty, monkeypatch, bucket_rows, large):
    from veracet.llm.substring_dedup import _counted

    monkeypatch.setattr(substring_dedup, "_counted", lambda *args: _with_large(large, _counted(*args)))
    rows = docs.collect()
    every = collections.Counter()
    for r in rows:
        w = words_of(r["text"])
        every.update(b" ".join(w[i : i + 35]) for i in range(len(w) - 34))
    want = []
    for r in rows:
        w = words_of(r["text"])
        gone = set()
        for i in range(len(w) - 34):
            if every[b" ".join(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((r["doc_id"], len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    out = substring_dedup.without_repeats(docs, bucket_rows=bucket_rows)
    assert by_id(map(tuple, out.collect())) == by_id(want)
    assert any(0 < x[2] < x[1] for x in want)
    assert substring_dedup.without_repeats(empty).collect() == []


def _with_large(large, run):
    """run, in a worker, with another limit for large buckets."""

    def limited(batches):
        before, substring_dedup.LARGE = substring_dedup.LARGE, large
        try:
            yield from run(batches)
        finally:
            substring_dedup.LARGE = before

    return limited


def check_packing(rows, capacity):
    for _, group in collections.Counter(r["sequence_id"] for r in rows).items():
        assert group
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing(docs, empty):
    rows = packing.packed(docs, capacity=256).collect()
    want = []
    for r in docs.collect():
        ids = np.array(ids_of("word_bpe_49k.json", r["text"], 1), "<u4")
        want += [(r["doc_id"], p, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes())) for p, a in enumerate(range(0, len(ids), 256))]
    assert by_id(tuple(r)[:5] for r in rows) == by_id(want)
    used = check_packing(rows, 256)
    assert used <= -(-sum(w[3] for w in want) // 256) + 4
    assert packing.packed(empty).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_plan_covers_all_pieces_and_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    capacity = [4096, 4096, 100, 64, 4096, 512][seed]
    lengths = np.minimum(capacity, 1 + rng.lognormal(np.log(capacity / [4, 2, 3, 8, 20, 5][seed]), 1, 5000).astype(int))
    counts = {int(k): int(v) for k, v in collections.Counter(lengths.tolist()).items()}
    sequences, rows = packing.plan(counts, capacity)
    load, taken = collections.Counter(), collections.Counter()
    for length, rank, pieces, first, each, offset in rows:
        assert rank == taken[length]
        taken[length] += pieces
        for r in range(pieces):
            s = first + r // each
            assert offset + r % each * length == load[s]
            load[s] += length
    assert dict(taken) == counts
    assert max(load.values()) <= capacity and len(load) == sequences
    if seed != 1:
        assert sequences <= 1.03 * (lengths.sum() / capacity) + 2
    assert packing.plan({}, capacity) == (0, [])


def near_components(rows, percent):
    """(doc_id, set size, component) of rows (doc_id, text, ...), by comparing all pairs."""
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").translate(low).encode())
        sets.append({b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {b" ".join(w)} if w else set())
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = collections.defaultdict(lambda: None)
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = d if least[find(i)] is None else min(d, least[find(i)])
    return [(d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, *_) in enumerate(rows)]


@pytest.mark.parametrize(("percent", "split", "broadcast"), [(80, 4096, 200_000), (80, 2, 0), (60, 4096, 200_000), (93, 3, 200_000), (100, 4096, 200_000)])
def test_near_duplicates(spark, empty, monkeypatch, percent, split, broadcast):
    monkeypatch.setattr(near_dup, "SPLIT", split)
    monkeypatch.setattr(near_dup, "join_small", lambda *args: store.join_small(*args, rows=broadcast))
    rng = random.Random(9)
    rows = [tuple(r)[:2] for r in corpus(50, seed=8)]
    vocabulary = ["".join(rng.choices(string.ascii_letters, k=5)) for _ in range(3000)]
    for base in range(8):  # chains: each a few changes from the one before, so that only neighbours link
        words = rng.choices(vocabulary, k=[8, 9, 12, 20, 40, 90, 150, 200][base])
        for step in range(8):
            rows.append((1000 + base * 10 + step, " ".join(words)))
            words = list(words)
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    for i in range(40):  # prefixes of one text: sizes from 4 on
        rows.append((1500 + i, " ".join(vocabulary[: 8 + i])))
    base = rng.choices(vocabulary, k=120)
    for i in range(60):  # many changed copies of one text, of which some pairs link
        words = list(base)
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((1700 + i, " ".join(words)))
    line = " ".join(rng.choices(vocabulary, k=25))
    rows += [(2000 + i, line + " " + " ".join(rng.choices(vocabulary, k=30))) for i in range(40)]
    want = near_components(rows, percent)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if split == 2:  # columns that bear the operator's own names
        df = df.withColumns({"node": F.lit("x"), "g": F.lit(1), "text_hash": F.lit(None), "component": F.lit(2.0)})
    assert by_id(map(tuple, near_dup.linked(df, percent=percent).collect())) == by_id(want)
    kept = near_dup.one_of_each(df, percent=percent)
    assert kept.columns == df.columns
    assert collections.Counter(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == collections.Counter(
        [c for c in {w[2] for w in want if w[1] and w[0] is not None}] + [w[0] for w in want if not w[1] and w[0] is not None]
    )
    assert near_dup.linked(empty).collect() == []


def test_near_duplicates_amid_a_passage_that_all_share(spark):
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(30))
    rows, want = [], []
    for i in range(2500):  # texts of 30 words of their own; of every fifth, three copies with another word changed
        own = [f"w{rng.randrange(10**6)}" for _ in range(70)]
        for k in range(4 if i % 5 == 0 else 1):
            words = [*own[:k], "changed", *own[k + 1 :]] if k else own
            rows.append((i * 10 + k, f"{' '.join(words)} {passage}"))
            want.append((i * 10 + k, 96, i * 10))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "120")
    try:
        got = near_dup.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert by_id(map(tuple, got)) == by_id(want)


def test_mixing(docs, empty):
    first, second = (by_id(map(tuple, mixing.mix_report(docs, block=8).drop("pieces", "text_hash").collect())) for _ in range(2))
    assert first == second
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for doc_id, source, size, source_size, goal, took in first:
        sizes[source] += size
        taken[source] += took
        target[source] = goal
        assert took <= 2 * size
    want = collections.Counter(len(words_of(r["text"])) for r in docs.collect())
    assert collections.Counter(r[2] for r in first) == want
    assert all(r[3] == sizes[r[1]] for r in first)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    free = [s for s in order if target[s] < 2 * sizes[s] - 1e-9]
    assert len({round(target[s] / weight[s], 6) for s in free}) <= 1
    for s in order:
        assert abs(taken[s] - target[s]) <= max(16, 0.02 * target[s])
    assert mixing.mix_report(empty).collect() == []
    mixed = mixing.mixed(docs, block=8)
    assert mixed.columns == docs.columns
    words, want = collections.Counter(), collections.Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(words_of(r["text"]))
    for r in first:
        want[r[0]] += r[5]
    assert +words == +want
    assert mixing.mixed(empty).collect() == []


def test_mixing_tells_rows_with_one_doc_id_apart(spark):
    """Texts of one size under one doc_id, and repeated rows: every word that the report counts is laid out, from its own text."""
    rows = [(1, " ".join(f"{t}{i}" for i in range(100)), "s", t) for t in "abc"] + [(1, " ".join(f"a{i}" for i in range(100)), "s", "a")] * 2 + [(2, "x y z", None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    report = mixing.mix_report(docs, block=4).collect()
    got = mixing.mixed(docs, block=4)
    assert got.columns == docs.columns
    words = collections.Counter(w for r in got.collect() for w in r["text"].split())
    hashes = {r["h"]: r["text"].split() for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    want = collections.Counter()
    for r in report:
        assert r["taken"] == sum(p["n"] * p["times"] for p in r["pieces"])
        for p in r["pieces"]:
            for w in hashes[r["text_hash"]][p["at"] : p["at"] + p["n"]]:
                want[w] += p["times"]
    assert words == want


def test_perplexity_base_rules(docs, empty):
    got = by_id(map(tuple, perplexity.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()))
    want = []
    for r in docs.collect():
        w, text = words_of(r["text"]), r["text"] or ""
        grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if words_of(x)]
        want.append((r["doc_id"], len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    assert got == by_id(want)
    assert perplexity.judged(empty).collect() == []


def kneser_ney(texts, order):
    """p(n-gram) of the last byte after the others, by recursion over plain dictionaries."""
    levels = [collections.Counter(t[i : i + order] for t in texts for i in range(len(t) - order + 1))]
    for _ in range(order - 1):
        levels.append(collections.Counter(g[1:] for g in levels[-1]))
    levels.reverse()
    cuts = []
    for level in levels:
        n1, n2, n3, n4 = (sum(c == k for c in level.values()) for k in (1, 2, 3, 4))
        if n1 and n2 and n3:
            y = n1 / (n1 + 2 * n2)
            cuts.append([0, *(min(max(d, 0.05), m) for d, m in zip((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), (0.95, 1.9, 2.9), strict=True))])
        else:
            cuts.append([0, 0.5, 0.75, 0.9])
    followers = [collections.defaultdict(list) for _ in levels]
    for level, lists in zip(levels, followers, strict=True):
        for g, c in level.items():
            lists[g[:-1]].append(c)

    def p(g):
        if not g:
            return 1 / 256
        level, cut, after = levels[len(g) - 1], cuts[len(g) - 1], followers[len(g) - 1].get(g[:-1])
        if not after:
            return p(g[1:])
        c = level.get(g, 0)
        return (c - cut[min(c, 3)] + sum(cut[min(x, 3)] for x in after) * p(g[1:])) / sum(after)

    return p


@pytest.mark.parametrize("shard", [3_000_000, 1500])
def test_perplexity_is_that_of_the_other_half(spark, docs, monkeypatch, shard):
    if shard == 1500:
        monkeypatch.setattr(perplexity, "PACKED", 700)
    rows = docs.filter("doc_id < 4 or doc_id > 58" if shard == 1500 else "true")
    half = {r["text"]: r["h"] for r in rows.select("text", F.pmod(F.xxhash64("text", F.lit(7)), F.lit(2)).alias("h")).collect()}
    got = perplexity.scored(rows, shard).collect()
    rows = rows.collect()
    assert len(got) == len(rows)
    clean = {t: b" ".join(words_of(t)) for t in half}
    model = {}
    for lang in {r["lang"] for r in rows}:
        for h in (0, 1):
            model[lang or "", h] = kneser_ney([clean[r["text"]] for r in rows if r["lang"] == lang and half[r["text"]] == h], perplexity.ORDER)
    want = []
    for r in rows:
        t, p, n = clean[r["text"]], model[r["lang"] or "", 1 - half[r["text"]]], perplexity.ORDER
        bits = [-np.log2(p(t[i : i + n])) for i in range(len(t) - n + 1)]
        want.append((r["doc_id"], *((sum(bits) / len(bits), sum(bits) / len(words_of(r["text"]))) if bits else (None, None))))
    for g, w in zip(by_id((r["doc_id"], r["bits_per_byte"], r["bits_per_word"]) for r in got), by_id(want), strict=True):
        assert g[0] == w[0]
        assert (g[1] is None) == (w[1] is None)
        if g[1] is not None:
            assert g[1:] == pytest.approx(w[1:], abs=0.02)


def test_probabilities_sum_to_one(spark):
    texts = [("the cat sat on the mat and the dog sat on the log with a cat " * 5 + str(i), "xx", i % 2) for i in range(6)]
    model = perplexity.train(spark.createDataFrame(texts, "text string, lang string, half int")).collect()
    for h in (0, 1):
        sums = collections.Counter()
        for r in model:
            if r[f"c{1 - h}"] or r[f"c{h}"]:
                sums[r["code"] >> 8] += r[f"p{h}"]
        seen = {r["code"] >> 8 for r in model if r[f"c{h}"]}
        assert seen and all(0.5 < sums[c] <= 1 + 1e-9 for c in seen)


def test_perplexity_rejects_noise_and_keeps_text(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices(["ba", "ne", "lo", "ti", "ra"], k=rng.randint(1, 3))) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=120)), "xx") for i in range(300)]
    rows += [(1000 + i, " ".join("".join(rng.choices("qxzjkvw0183!", k=9)) for _ in range(80)), "xx") for i in range(5)]
    out = {r["doc_id"]: r["kept"] for r in perplexity.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i] for i in range(300))
    assert not any(out[1000 + i] for i in range(5))


def test_exact_dedup(docs, empty):
    rows = docs.collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[normal(r["text"])].append(r["doc_id"])
    first = lambda ids: None if None in ids else min(ids)
    out = exact_dedup.exact_groups(docs).collect()
    want = [(r["doc_id"], first(groups[normal(r["text"])]), len(groups[normal(r["text"])]), hashlib.sha256(normal(r["text"]).encode()).hexdigest()) for r in rows]
    assert by_id((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out) == by_id(want)
    assert collections.Counter(r["text_sha256"] for r in out if r["kept"]) == collections.Counter({w[3] for w in want})
    assert all(r["doc_id"] == r["keep_id"] for r in out if r["kept"])
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert collections.Counter(normal(r["text"]) for r in kept.collect()) == collections.Counter(groups.keys())
    assert exact_dedup.exact_groups(empty).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_golomb_round_trip(n):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, 1 << 40, n))
    k, raw = exact_dedup.golomb_encode(values)
    assert exact_dedup.golomb_decode(k, raw, len(values)).tolist() == values.tolist()
    if n > 10:
        assert len(raw) < 6 * len(values)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 70_001])
def test_rans_round_trip_checkpoints_and_damage(n):
    from veracet.llm.rans import CHECKPOINT_ROWS, Table, decode_block, encode_block

    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 50_000).astype(np.uint32)
    symbols, counts = np.unique(np.append(ids, 7), return_counts=True)
    table = Table.fitted(symbols, counts)
    block = encode_block(ids, table)
    assert decode_block(block, table).tolist() == ids.tolist()
    if n > 1000:
        assert len(block) < 2 * n
        step = CHECKPOINT_ROWS * min(512, n // 64)
        assert decode_block(block, table, 1).tolist() == ids[step:].tolist()
        with pytest.raises(ValueError, match="damaged"):
            decode_block(block[:-1] + bytes([block[-1] ^ 1]), table)


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    docs.drop("kind", "_id").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dup", "mixing", "packing"]
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = df.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == columns, name
        df = corpus_pipeline.written(df, "test-stage")
        assert df.count() > 0
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_packing(rows, packing.CAPACITY)
    want = sum(len(ids_of("word_bpe_49k.json", r["text"], 1)) for r in df.collect())
    assert sum(r["length"] for r in rows) == want
