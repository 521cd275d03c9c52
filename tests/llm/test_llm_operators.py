"""Each document operator against plain Python, on the small tables and on odd rows."""

import html
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from llm_brute import edits, groups, repeats, sha
from tokenizers import Tokenizer

from triagelens.llm import (
    bpe, fingerprints, html_extraction, jaccard_join, license_scan, mixing, quality_model,
    quality_rules, secret_scan, suffix_dedup,
)
from triagelens.llm.queries import QUERIES, SQL
from verification.compare import compare, connect

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, _row int"
LONG = "word " * 30_000
ODD = [
    (1, None, None, None, None, 1, None, 1), (2, "", "en", "a", 0, 1, True, 1), (3, " \n\t ", "en", "a", 4, 1, True, 1),
    (4, LONG, "en", None, 1, 1, True, 1), (5, "x" * 60_000, "en", "b", 1, 1, True, 1),
    (6, "one two three", "en", "b", 1, 1, True, 1), (7, "One two  three", "en", "b", 1, 1, True, 1),
    (8, "token = abcdef AKIA" + "A" * 16 + " https://a.example/x", "en", "c", 1, 1, True, 1),
    (9, LONG, "en", "c", 1, 1, True, 1), (10, "All rights reserved. CC BY-NC 4.0 ÄÖ", "de", "c", 1, 1, True, 1),
]


@pytest.fixture(scope="module")
def docs(sf_dir):
    d = pq.read_table(f"{sf_dir}/documents.parquet").to_pandas()
    return list(zip(d.doc_id.tolist(), d.text.fillna("").tolist(), strict=True))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def repeated(spark):
    """Equal rows, equal ids with different texts, and missing ids."""
    rows = [ODD[5], ODD[5], (6, "another text", *ODD[5][2:]), (None, "no id", *ODD[5][2:]), (None, None, *ODD[5][2:])]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    ok, note = compare(spark, connect(sf_dir), sf_dir, QUERIES[name], SQL[name])
    assert ok, note


@pytest.mark.parametrize("name", sorted(SQL))
def test_odd_rows_as_sql(spark, tmp_path, name, odd):
    odd.coalesce(1).toPandas()[["doc_id", "text", "lang", "source", "n_chars"]].to_parquet(tmp_path / "documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    ok, note = compare(spark, con, str(tmp_path), QUERIES[name], SQL[name])
    assert ok, note


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


OVER_DOCUMENTS = {
    "fingerprints": fingerprints.fingerprints, "bpe": lambda d: bpe.token_digests(d, VOCABULARY),
    "licenses": license_scan.license_scan, "suffixes": suffix_dedup.suffix_dedup,
    "secrets": secret_scan.secret_scan, "rules": quality_rules.quality_rules,
    "jaccard": jaccard_join.near_duplicates, "mix": mixing.mix,
    "model": lambda d: quality_model.quality_scores(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality")),
}


@pytest.mark.parametrize("name", sorted(OVER_DOCUMENTS))
def test_one_row_per_document(name, odd, empty, repeated):
    run = OVER_DOCUMENTS[name]
    assert run(empty).count() == 0
    assert sorted(r["doc_id"] for r in run(odd).collect()) == list(range(1, 11))
    assert Counter(r["doc_id"] for r in run(repeated).collect()) == Counter({6: 3, None: 2})


@pytest.mark.parametrize("run", [quality_rules.drop_rejected, jaccard_join.one_of_each, secret_scan.redacted,
                                 mixing.mixed_documents])
def test_filters_keep_columns(run, odd, empty, repeated):
    for d in (odd, empty, repeated):
        found = run(d)
        assert found.columns == d.columns
        assert found.count() <= 3 * d.count()


def test_fingerprints(spark, sf_dir, docs, odd):
    rows = by_id(QUERIES["op1_fingerprints"](spark, sf_dir))
    for d, text in edits(docs).items():
        assert rows[d]["edited_sha256"] == sha(text.encode())
    long_ones = [rows[d] for d, t in docs if len(t) > 300]
    assert all(0.5 < r["near_edited"] < 1 for r in long_ones)
    assert sum(r["near_next"] > 0.3 for r in long_ones) < 0.02 * len(long_ones)
    same = {t: rows[d]["fingerprint"] for d, t in docs}
    assert all(rows[d]["fingerprint"] == same[t] for d, t in docs)
    found = by_id(fingerprints.fingerprints(odd))
    assert found[1]["fingerprint"] == found[2]["fingerprint"] == "" and found[2]["near_next"] == 1.0
    assert found[4]["fingerprint"] == found[9]["fingerprint"] and found[4]["n_chars"] == len(LONG)
    for d, text in edits([(r[0], r[1]) for r in ODD]).items():
        assert found[d]["edited_sha256"] == sha(text.encode())


def test_chunks_resist_shifts():
    rng = random.Random(3)
    text = bytes(rng.choice(b"abcdefgh ") for _ in range(20_000))
    a, b = fingerprints.chunk_sets([text, b"inserted " + text])
    assert fingerprints.likeness(a, b) > 0.99
    assert sum(a[1]) <= len(text) and max(a[1]) <= fingerprints.LARGEST
    assert np.array_equal(fingerprints.chunk_sets([b"other " * 9, text])[1][0], a[0])


def test_tokens(spark, sf_dir, docs):
    library = Tokenizer.from_file(VOCABULARY)
    rows = by_id(QUERIES["op2_bpe"](spark, sf_dir))
    for d, t in docs:
        ids = library.encode(t, add_special_tokens=False).ids
        assert rows[d]["n_tokens"] == len(ids)
        assert rows[d]["ids_sha256"] == sha(np.array(ids, "<u4").tobytes())
        assert rows[d]["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False).encode())


@pytest.mark.parametrize("text", [
    "", "  \n", "a<|endoftext|>b <|startoftext|>'s don't I'LL ΣΑΣ", "café café İstanbul \x1c x\x1cy",
    "x" * 5000, "日本語 🎉👨‍👩‍👧 ½ Ⅳ ٣", "'S 'T it's'll''ve", "\x00 a\x00b", "$$$### a1b2c3", "​  x"])
def test_tokens_of_odd_texts(text):
    library, own = Tokenizer.from_file(VOCABULARY), bpe.Codec(VOCABULARY)
    ids = library.encode(text, add_special_tokens=False).ids
    data, decoded = own.encode(text)
    assert np.frombuffer(data, "<u4").tolist() == ids
    assert decoded == library.decode(ids, skip_special_tokens=False)


def test_merges_look_ranks_up_once():
    """One look-up per pair of the word and two per merge; queue entries need none."""
    looked = []

    class Counted(dict):
        def get(self, *args):
            looked.append(args)
            return super().get(*args)

    own = bpe.Codec(VOCABULARY)
    plain = own.encode("internationalisation " * 2)
    own.words.clear(), own.cache.clear()
    own.ranks = [Counted(r) for r in own.ranks]
    assert own.encode("internationalisation " * 2) == plain
    n = len("internationalisation")
    merges = n - len(own.words["internationalisation"][0]) // 4
    assert merges and len(looked) <= n - 1 + 2 * merges


def test_encoded_keeps_columns(odd):
    found = bpe.encoded(odd, VOCABULARY)
    assert found.columns == [*odd.columns, "n_tokens", "ids", "decoded"]
    row = found.filter("doc_id = 6").first()
    assert len(row["ids"]) == 4 * row["n_tokens"] and row["decoded"] == "one</w> two</w> three</w>"


def test_license_index_uses_rare_words():
    postings = license_scan.index({w: 1000 for t in license_scan.TEMPLATES for w in t.words} | {"cc": 1, "gnu": 2})
    assert (0, 0) in postings["cc"] and "gnu" in postings
    assert len({t for p in postings.values() for t, _ in p}) == len(license_scan.TEMPLATES)


def test_suffix_intervals():
    rng = random.Random(1)
    for _ in range(150):
        letters, least = rng.choice([b"a", b"ab", b"abcd", bytes(range(256))]), rng.choice([1, 2, 3, 5, 8])
        texts = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 6))]
        texts += [texts[0], texts[0][3:] + b"zz"] * rng.randint(0, 1)
        symbols, starts = suffix_dedup.block_text(texts)
        seen = Counter(t[i:i + least] for t in texts for i in range(len(t) - least + 1))
        assert set(suffix_dedup.long_neighbours(symbols, least).tolist()) == {
            int(s) + i for s, t in zip(starts, texts, strict=True) for i in range(len(t) - least + 1)
            if seen[t[i:i + least]] > 1}


@pytest.mark.parametrize("block", [1 << 20, 3000])
def test_suffix_dedup(spark, sf_dir, docs, block, monkeypatch):
    """Also with blocks so small that grams are counted window by window."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rows = by_id(QUERIES["op4_suffix_dedup"](spark, sf_dir))
    for (d, _), want in zip(docs, repeats([t.encode() for _, t in docs], 400), strict=True):
        r = rows[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want


def test_suffix_dedup_of_equal_rows(spark):
    """Many rows without an id and with one text: removed whole, and each span is kept once."""
    text = " ".join(f"word{i}" for i in range(120))
    rows = spark.createDataFrame([(None, text)] * 300 + [(1, "short")], "doc_id long, text string").repartition(4)
    out = suffix_dedup.suffix_dedup(rows).collect()
    assert len(out) == 301
    assert {(r["doc_id"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["changed"]) for r in out} == {
        (None, len(text), 1, sha(b""), True), (1, 0, 0, sha(b"short"), False)}


def test_suffix_dedup_of_odd_texts(odd):
    rows = by_id(suffix_dedup.suffix_dedup(odd))
    for r, want in zip(ODD, repeats([(r[1] or "")[:3000].encode() for r in ODD], 400), strict=True):
        n = len(r[1] or "")
        got = rows[r[0]]
        assert got["n_bytes"] == len((r[1] or "").encode())
        assert got["n_removed"] == (n if want[1] else 0) and got["n_spans"] == want[2]


def test_pages(spark, sf_dir):
    d = pq.read_table(f"{sf_dir}/pages.parquet").to_pandas()
    rows = {r["page_id"]: r for r in QUERIES["op5_html_extraction"](spark, sf_dir).collect()}
    for i, page in zip(d.page_id, d.html, strict=True):
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n\n".join(b for b in blocks if b)
        assert rows[i]["text"] == want and rows[i]["n_chars"] == len(want)


def test_field_on_unseen_layouts(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model, right, total = html_extraction.trained(pages), 0, 0
    for page, labels in html_extraction.layouts([f"Sentence number {i} of the held out text." * (i % 5 + 1) for i in range(99)], 200):
        got = model.decode(html_extraction.features(html_extraction.Reader().read(page), {}))
        if len(got) == len(labels):
            right, total = right + sum(a == b for a, b in zip(got, labels, strict=True)), total + len(labels)
    assert right > 0.98 * total > 1000


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    model = html_extraction.Field(rng.normal(size=html_extraction.FEATURES), rng.normal(size=(2, 2)), rng.normal(size=2))
    rows = [rng.integers(0, html_extraction.FEATURES, 4).tolist() for _ in range(8)]

    def score(path):
        return sum(model.emit[r].sum() * s for r, s in zip(rows, path, strict=True)) + model.first[path[0]] + sum(
            model.step[a, b] for a, b in zip(path, path[1:]))

    best = max((tuple(map(int, f"{k:08b}")) for k in range(256)), key=score)
    assert [int(x) for x in model.decode(rows)] == list(best)


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<main><p>a &amp; b</p> tail<br>more</main><aside>x</aside>"),
            (4, "u", "<p don't>hi</p><"), (5, "u", "<article>" + "<p>long text of words. " * 5000 + "</article>"),
            (None, "u", "<script>var x = '<p>no</p>'</script>"), (3, "u", "<!-- <p>no</p> --><main>yes it is.</main>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"]) for r in html_extraction.main_texts(df).collect()]
    assert (3, "a & b\n\ntail more") in got and (1, "") in got and (2, "") in got and len(got) == 7
    assert next(t for i, t in got if i == 5).count("long text of words.") == 5000
    assert not [t for _, t in got if "no" in t]
    assert html_extraction.main_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize("page, want", [
    ('<article><p>One</p><svg class="i"/><p>Two</p><p>Three</p></article>', ["One", "Two", "Three"]),
    ("<p>One</p><math/><p>Two</p><svg/><p>Three</p><svg><text>no</text></svg>", ["One", "Two", "Three"]),
    ("<p>One</p><svg><path d='M0'><p>Two</p><svg><title>no</title></svg><p>Three</p>", ["One", "Two", "Three"]),
    ("<p>One</p><noscript><p>Two</p><noscript>no</noscript><p>Three</p>", ["One", "Two", "Three"]),
    ("<p>One</p><template><p>Two</p>", ["One", "Two"]),
    ("<p>One<svg><svg/><svg><text>no</text></svg><text>no</text></svg></p><template><p>no</p></template>", ["One"]),
    ("<p>One<noscript><img src='a'>no</noscript></p><script>no", ["One"]),
    ("<p>Let <math><mi>x</mi> <mo>=</mo> <mn>2</mn></math> hold.</p>", ["Let x = 2 hold."]),
    ("<p title=it's>He said it's fine</p>", ["He said it's fine"]),
    ("<p title='a>b' class=\"c>d\">One</p><p title = it's>Two</p><a href=?q=\"x>Three</a>", ["One", "Two", "Three"]),
])
def test_text_behind_odd_tags(page, want):
    assert [b.text for b in html_extraction.Reader().read(page)] == want


def test_quality_on_held_out_labels(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    rows = QUERIES["op6_quality_model"](spark, sf_dir).toPandas()
    labels = pq.read_table(f"{sf_dir}/labels.parquet").to_pandas()
    both = rows.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert len(rows) == rows.doc_id.nunique() and rows.score.between(0, 1).all()
    assert ((held.score >= 0.5) == (held.quality == 1)).mean() > 0.9
    import zlib
    assert (rows.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in rows.doc_id]).all()
    assert ((rows.score >= 0.7).astype(int) == rows.predicted).all()


def test_every_word_has_its_own_vector(spark):
    rng = random.Random(3)
    names = ["".join(rng.choices("abcdefghij", k=9)) for _ in range(6000)]
    texts = [(1, " ".join(names)), (None, " ".join(names[:50])), (2**60 + 1, ""), *((10 + i, w) for i, w in enumerate(names[:3000]))]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: np.frombuffer(r["vector"], np.float32) for r in quality_model.document_vectors(df).collect()}
    assert set(rows) == {t[0] for t in texts} and not rows[2**60 + 1].any()
    assert rows[1][quality_model.SIZE + 3] == 1.0  # all its words are different
    alone = np.stack([rows[10 + i] for i in range(3000)])
    assert len(np.unique(alone, axis=0)) == 3000  # more words than there were classes
    small = {r["doc_id"]: np.frombuffer(r["vector"], np.float32) for r in quality_model.document_vectors(df, 1000).collect()}
    assert all(np.allclose(rows[d], small[d], atol=1e-5) for d in rows)  # sums meet over all chunks


def test_quality_ignores_held_out_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 "
                               "THEN 1 - quality ELSE quality END AS quality")
    a, b = (by_id(quality_model.quality_scores(docs, x)) for x in (labels, turned))
    assert a == b


def test_weak_secrets_need_their_complement(spark):
    key = "aB3" * 14
    access = "AKIA" + "Q" * 16
    texts = {1: f"k {key}", 2: f"{access} k {key}", 3: f"{access} https://h.example/x", 4: f"{access} {key} https://h.example/x",
             5: access + " " * 400 + key, 6: "secret:token:abcdef passwd='12345'"}
    rows = by_id(secret_scan.secret_scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    kinds = {d: [s.split(":")[0] for s in r["spans"].split(",") if s] for d, r in rows.items()}
    assert kinds == {1: [], 2: ["access", "key"], 3: ["access"], 4: ["access", "key", "endpoint"], 5: ["access"], 6: []}


def test_redaction(spark):
    text = 'é token = "' + "0a1b2c3d" * 4 + '" end AKIA' + "Z" * 16
    df = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (2, None, "z")], "doc_id long, text string, extra string")
    rows = sorted(secret_scan.redacted(df).collect())
    assert rows == [(1, 'é [secret]" end [secret]', "x"), (1, 'é [secret]" end [secret]', "y"), (2, None, "z")]


def test_rules_on_hosts(spark):
    good, bad = " ".join(f"word{i}" for i in range(60)), "x"
    rows = [(i, good if i % 10 == 0 or i % 2 else bad, "bad" if i % 2 == 0 else "good") for i in range(200)]
    found = by_id(quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert all(found[i]["kept"] for i in range(1, 200, 2))
    assert not any(found[i]["kept"] for i in range(0, 200, 2))


@pytest.mark.parametrize("frequent", [0, 50])
def test_jaccard_join(spark, sf_dir, docs, frequent, monkeypatch):
    """Also with every repeated shingle called frequent, so that pairs are indexed."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    rows = by_id(QUERIES["op9_jaccard_join"](spark, sf_dir))
    want = groups(docs)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in rows.items()} == want


def test_linked_sets_share_an_index_entry():
    rng = np.random.default_rng(4)
    frequent = rng.integers(0, 256, 1 << (jaccard_join.TABLE_BITS - 3), dtype=np.uint8)
    repeated = np.full_like(frequent, 255)
    for n in [*range(2, 40), 100, 333, 1000]:
        for _ in range(12):
            s = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a = np.unique(s[:n])
            gone = int(rng.integers(0, n // 7 + 1))
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[gone:]], s[n:n + gone]]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 75 * (len(a) + len(b) - common):
                x, y = (np.concatenate(jaccard_join.signatures(z, frequent, repeated)) for z in (a, b))
                assert len(np.intersect1d(x, y)), (n, gone)


def near(i, changed=()):
    """A text of a hundred words; ``changed`` words make few shingles differ."""
    return " ".join(f"t{i}c{k}" if k in changed else f"t{i}w{k}" for k in range(100))


def test_links_through_documents_without_an_id(spark):
    rows = [(1, near(1)), (None, near(1, {20, 40})), (2, near(1, {20, 40, 60, 80})),  # 1 and 2 alone do not link
            (7, near(1)), (7, near(7)), (None, near(8)), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect())
    assert got == Counter([(1, 1), (None, 1), (2, 1), (7, 1), (7, 7), (None, None), (3, 3)])


def test_one_row_of_each_group(spark):
    rows = [(1, near(1), "b"), (1, near(1), "a"), (1, near(1), "b"), (None, near(1), "x"),  # repeats, a copy without an id
            (3, near(3), "a"), (7, near(3), "a"), (7, near(7), "a"),  # a copy and a text of its own under one id
            (None, near(8), "n"), (None, near(8), "m"), (None, near(8, {99}), "n"), (9, "", "a"), (None, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = jaccard_join.one_of_each(df).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got if r["doc_id"]) == Counter(
        [(1, near(1)), (3, near(3)), (7, near(7)), (9, "")])
    assert sorted(r["text"] or "" for r in got if r["doc_id"] is None)[0] == ""
    assert sum(r["doc_id"] is None for r in got) == 2
    assert [r["source"] for r in got if r["doc_id"] == 1] == ["a"]


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(9)
    for n, m in ((3, 5), (400, 500), (900, 5000), (6000, 7000)):
        s = np.unique(rng.integers(0, 1 << 63, n + m, dtype=np.uint64))
        a, b = s[:n], s[n // 2:]
        x, y = jaccard_join.parity(a), jaccard_join.parity(b)
        bits = np.bitwise_count(jaccard_join.folded(x, len(y)) ^ jaccard_join.folded(y, len(x))).sum()
        assert bits <= len(np.setxor1d(a, b))
        assert jaccard_join.folded(x, len(x) // 2 or 1).size <= len(x)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 60), (60, 80), (7, 7)]
    got = {r["node"]: r["component"] for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {60: 60, 80: 60, 100: 60}


def test_mix_hits_its_targets(spark, sf_dir):
    rows = QUERIES["op10_mixing"](spark, sf_dir).toPandas()
    source = pq.read_table(f"{sf_dir}/documents.parquet").to_pandas()[["doc_id", "source"]]
    rows = rows.merge(source, on="doc_id")
    assert (rows.taken <= 3 * rows["size"]).all()
    per = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(per.taken - per.target) <= 1).all() and (per.target <= 3 * per["size"] + 1e-6).all()
    assert abs(per.target.sum() - rows["size"].sum()) < 1e-3 * len(per)
    again = QUERIES["op10_mixing"](spark, sf_dir).toPandas()
    pd.testing.assert_frame_equal(rows[again.columns].sort_values("doc_id", ignore_index=True),
                                  again.sort_values("doc_id", ignore_index=True))


def test_mixture_of_repeated_rows_hits_its_targets(spark):
    def row(i, source):
        return i, " ".join(f"w{i}x{k}" for k in range(10 + i % 7)), source, i

    rows = [row(i, "a") for i in range(40)] * 2 + [row(100 + i, "b") for i in range(30)] + [row(200 + i, None) for i in range(30)]
    rows += [row(5, "b"), row(6, "b"), (None, *row(7, "a")[1:]), (None, *row(7, "a")[1:]), (5, *row(5, "a")[1:3], 99)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(3)
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len(r[1].split())
    goals = {r["source_size"]: int(r["target"] + 0.5) for r in mixing.mix(df).collect()}
    assert len(set(sizes.values())) == len(sizes) == len(goals)
    got = Counter()
    for r in mixing.mixed_documents(df).collect():
        got[r["source"]] += len(r["text"].split())
    assert got == {s: goals[n] for s, n in sizes.items()}


def test_mix_prefers_better_documents(spark):
    rows = [(i, "word " * 10 if i % 2 else "w$$$$ " * 10, "a") for i in range(2000)] + [(5000, "word " * 15000, "b")]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    a = found[found.doc_id < 2000]
    extra = a[a.taken > 10 * (a.taken.min() // 10)]
    assert (extra.doc_id % 2 == 1).mean() > 0.6
