"""The pipeline, stage by stage, against plain Python."""

from collections import Counter

import numpy as np
import pytest
from llm_brute import groups, sha
from tokenizers import Tokenizer

import corpus_pipeline
from triagelens.llm import mixing, quality_rules, secret_scan
from triagelens.llm.common import stored, table
from triagelens.llm.queries import vocabulary


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = [table(spark, sf_dir, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], sf_dir), "stage"))
    return docs


def test_columns(stages):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_quality_rules_drop_what_they_reject(stages):
    kept = {r["doc_id"] for r in quality_rules.quality_rules(stages[0]).filter("kept").collect()}
    rows = {r["doc_id"]: r for r in stages[0].collect()}
    assert {r["doc_id"]: r for r in stages[1].collect()} == {d: rows[d] for d in kept}


def test_one_document_of_each_group(stages):
    before = {r["doc_id"]: r for r in stages[1].collect()}
    firsts = {c for _, c in groups([(d, r["text"]) for d, r in before.items()]).values()}
    assert {r["doc_id"]: r for r in stages[2].collect()} == {d: before[d] for d in firsts}


def test_secrets_are_replaced(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.secret_scan(stages[2]).collect()}
    after = stages[3].collect()
    assert len(after) == len(before)
    for r in after:
        text, runs = before[r["doc_id"]], []
        for s in filter(None, spans[r["doc_id"]].split(",")):
            a, b = map(int, s.split(":")[1:])
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b])
        for a, b in reversed(runs):
            text = text[:a] + secret_scan.MASK + text[b:]
        assert r["text"] == text and r["n_chars"] == len(text)


def test_mixture_takes_what_the_mix_says(stages):
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(stages[3]).collect()}
    words = Counter()
    for r in stages[4].collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert words == Counter({d: n for d, n in taken.items() if n})


def test_tokens_of_every_row(stages, spark, sf_dir):
    library = Tokenizer.from_file(vocabulary())

    def digest(ids: bytes) -> str:
        return sha(ids)

    want = Counter((r["doc_id"], digest(np.array(library.encode(r["text"], add_special_tokens=False).ids, "<u4").tobytes()))
                   for r in stages[4].collect())
    assert Counter((r["doc_id"], digest(bytes(r["ids"]))) for r in stages[5].collect()) == want
    assert Counter((r["doc_id"], digest(bytes(r["ids"]))) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want
