"""Whitening, spelling variants and token files against plain Python, and their defined cases."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from llm_brute import spellings, token_stream, whole_steps
from tokenizers import Tokenizer

from triagelens.llm import spelling, token_files, whitening
from triagelens.llm.queries import QUERIES

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# ------------------------------------------------------------------------ whitening
def test_whitening_equals_dense_eigenvectors(spark, sf_dir):
    rows = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pylist()
    kept, x = whole_steps([r["embedding"] for r in rows])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    covariance = np.cov(fit.T, bias=True)
    e, u = np.linalg.eigh(covariance)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    want = (x - total / n) @ u / np.sqrt(e)
    found = QUERIES["op11_whitening"](spark, sf_dir).toPandas()
    assert len(found) == 16 * len(kept) and set(found.n) == {n}
    assert found.identity_error.nunique() == 1 and found.identity_error.max() < 1e-9
    by_row = found.set_index(["vec_id", "component"]).sort_index()
    order = np.argsort([rows[i]["vec_id"] for i in kept])
    whitened = by_row.whitened.to_numpy().reshape(-1, 16)
    signs = np.sign((whitened * want[order]).sum(axis=0))
    assert np.abs(whitened - want[order] * signs).max() < 1e-8
    assert np.allclose(by_row.explained.to_numpy()[:16], e / np.trace(covariance), rtol=1e-10)
    exact = ((n * x - total) ** 2).sum(axis=1)[order]
    assert (by_row.deviation.to_numpy().reshape(-1, 16) == exact[:, None]).all()


def test_whitening_defined_cases(spark):
    rows = spark.createDataFrame(
        [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 1), (None, [3.0, float("nan")], 0), (2, None, 0), (3, [None, 1.0], 0),
         (4, [1.0], 0), (None, [2.0, -1.0], 0), (2 ** 60 + 1, [5.0, 7.0], 0), (6, [], 0), (7, [1.0, float("inf")], 0)],
        "vec_id long, embedding array<double>, component int").repartition(3)
    found = whitening.whiten(rows).collect()
    # two equal rows are each returned and count once; the missing id stays; other lengths go
    assert sorted((r["vec_id"] or 0) for r in found if r["component"] == 1) == [0, 1, 1, 2 ** 60 + 1]
    assert {r["n"] for r in found} == {3}
    same = whitening.whiten(rows.filter("vec_id = 1"))
    assert same.count() == 0 and same.columns[0] == "vec_id"
    assert whitening.whiten(rows.limit(0)).count() == 0


def test_whitening_deviation_beyond_a_long(spark):
    rows = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [1.0, -4.0])], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whitening.whiten(rows).filter("vec_id = 1").collect()} == {None}


@pytest.mark.parametrize("seed", range(4))
def test_inertia_and_contours(seed):
    draw = np.random.default_rng(seed)
    q = np.linalg.qr(draw.standard_normal((40, 40)))[0]
    values = draw.random(40) ** 3
    values[:5] = values[0]  # equal eigenvalues
    values[10:14] = 0
    a = (q * values) @ q.T
    a = (a + a.T) / 2 / values.sum()
    exact = np.sort(values / values.sum())[::-1]
    for shift in (1e-9, 0.003, 0.02, 0.05, 0.9):
        assert whitening.above(a, shift) == (exact > shift).sum()
    found = np.concatenate([whitening.contour(a, *i)[0] for i in whitening.intervals(a, 16)])
    assert len(found) >= 16 and np.allclose(np.sort(found)[::-1][:16], exact[:16], rtol=1e-10)


# ------------------------------------------------------------------------- spelling
def as_dict(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spellings_equal_brute_force(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    want = spellings([(r["doc_id"], r["text"]) for r in docs])
    assert sum(w[0] is not None for w in want.values()) > 50
    assert as_dict(QUERIES["op12_spelling"](spark, sf_dir)) == want


def test_spellings_of_dense_words(spark):
    """Many words one edit apart, over a small alphabet, so that tries are dense."""
    draw = random.Random(3)
    words = {"".join(draw.choice("abé") for _ in range(draw.randint(5, 9))) for _ in range(400)}
    words |= {"a" * n for n in range(5, 30)}
    docs = [(i, " ".join([w] * draw.randint(3, 40))) for i, w in enumerate(sorted(words))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = spellings(docs)
    assert max(w[3] for w in want.values()) > 8
    assert as_dict(spelling.spelling_variants(df)) == want


def test_spellings_defined_cases(spark):
    long = "x" * 3000
    rows = [(None, "Abcde abcde abcde abcde", 1), (None, "Abcde abcde abcde abcde", 1), (1, None, 2), (2, "", 3),
            (3, f"{long} {long} {long} {long[1:]}y {long[1:]}y {long[1:]}y", 4),
            (3, "abcdé abcdé abcdé bcdeé bcdeé bcdeé abcd abcd abcd", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word int")
    assert as_dict(spelling.spelling_variants(df)) == spellings([r[:2] for r in rows])
    empty = spelling.spelling_variants(df.limit(0))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.count() == 0


def test_roots_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("a", "w5")], "word string, form string")
    assert {r["root"] for r in spelling.roots(links).collect()} == {"w37"}


# ---------------------------------------------------------------------- token files
def test_token_stream_equals_library(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    want = token_stream([(r["doc_id"], r["text"]) for r in docs], Tokenizer.from_file(TOKENIZER))
    found = QUERIES["op13_token_files"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in found} == want


def test_units_encode_as_whole_texts():
    draw, library, own = random.Random(5), Tokenizer.from_file(TOKENIZER), token_files.Encoder(TOKENIZER)
    letters = [*"ab1é'sS.,  \n\t\r\xa0\x85\x1c\x00ñ—…€漢🙂", "'s", "'ll", " 're", "<|endoftext|>", "  ", " "]
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(5000)]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u2").tobytes() for t in texts]
    assert own.encode(texts) == want


def test_token_files_give_sequences_without_a_copy(spark, tmp_path):
    docs = [(i, "one two three " * (i % 50)) for i in range(200)] + [(1000, "four five " * 20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    manifest = token_files.write_token_files(df, TOKENIZER, str(tmp_path / "files"), length=64).orderBy("file_no").collect()
    library = Tokenizer.from_file(TOKENIZER)
    stream = []
    for r in manifest:
        assert r["start"] == len(stream)
        file, ids = token_files.SequenceFile(r["path"]), []
        assert len(file) == r["n_sequences"]
        mapped = pa.total_allocated_bytes()
        for i in range(len(file)):
            sequence, mask = file.sequence(i), np.array(file.mask(i).to_pylist())
            assert len(sequence) == 64 and not sequence.flags.owndata
            ids += sequence[mask].tolist()
        assert pa.total_allocated_bytes() - mapped < 1 << 16
        assert len(ids) == r["n_tokens"]
        stream += ids
    want = [i for _, t in docs for i in [*library.encode(t, add_special_tokens=False).ids, 2]]
    assert stream == want


def test_token_stream_defined_cases(spark):
    rows = [(None, "a", 1), (None, None, 1), (2, "x y\n z <|endoftext|> é  ", 1), (2, "日本 語", 1), (2 ** 60 + 1, "", 1),
            (-5, " lead\n\n x\t y" * 3000, 1)] + [(7, "same text", 1)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(4)
    found = token_files.token_stream(df, TOKENIZER).orderBy("start").collect()
    library = Tokenizer.from_file(TOKENIZER)
    coded = sorted((r[0] or -9, zlib.crc32(np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2],
                                                    dtype="<u4").tobytes())) for r in rows)
    assert sorted((r["doc_id"] or -9, r["ids_crc32"]) for r in found) == coded
    assert [r["doc_id"] for r in found] == [None, None, -5, 2, 2, *[7] * 300, 2 ** 60 + 1]
    ends = [r["start"] + r["n_tokens"] for r in found]
    assert [r["start"] for r in found] == [0, *ends[:-1]]
    assert token_files.token_stream(df.limit(0), TOKENIZER).count() == 0


def test_an_id_of_many_rows_is_spread(spark, tmp_path):
    df = spark.range(4000).selectExpr("if(id % 2 = 0, 5, id) as doc_id", "'text' as text").repartition(8)
    files = token_files.write_token_files(df, TOKENIZER, str(tmp_path / "f")).agg({"n_documents": "max"}).first()[0]
    assert files < 1200
