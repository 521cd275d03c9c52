"""Semantics, properties and storage of the operators."""

import json
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelens.operators import classifier as C
from triagelens.operators import clusters as U
from triagelens.operators import dossier as D
from triagelens.operators import fusion as G
from triagelens.operators import normalise as N
from triagelens.operators import robustness as B
from triagelens.operators import zero_shot as Z
from triagelens.operators.encoding import class_codes, fit_label_encoder
from triagelens.operators.quantiles import exact_quantiles
from triagelens.operators.resolution import fit_resolution
from triagelens.plans import audit as P
from triagelens.plans.catalog import canonical, labelled
from triagelens.plans.storage import load_run, save_run, versions
from triagelens.profiles import CPU, FULL
from triagelens.sources import tickets as S


def test_missing_priority_column_fails_before_any_job(spark):
    with pytest.raises(ValueError):
        N.normalise(spark.createDataFrame([("a",)], "subject string"), FULL)


def test_aliases_and_defaults(spark):
    df = spark.createDataFrame([("s", "High ", "p2", "9")],
                               "`Subject ` string, Priority_Level string, Priority string, `Resolution Time` string")
    row = N.normalise(df, FULL).first()
    assert (row["ticket_subject"], row["priority_numeric"], row["resolution_hours"]) == ("s", 3, 9.0)
    assert (row["ticket_channel"], row["customer_domain"], row["is_enterprise"]) == (
        "Unknown", "unknown.com", 1)
    assert row["ticket_id"].startswith("T")


def test_row_ids_are_positions(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write("subject,description,priority\n" + "".join(f"s{i},d,Low\n" for i in range(50)))
    rows = N.normalise(S.read_tickets(spark, path), FULL, ids="position").collect()
    assert {r["ticket_subject"]: r["ticket_id"] for r in rows} == {
        f"s{i}": f"T{i:05d}" for i in range(50)}


def test_exact_quantiles_brute_force(spark):
    rng = random.Random(2)
    rows = [("hot", 7.0)] * 500
    rows += [("wide", rng.expovariate(1) ** 9) for _ in range(777)]
    rows += [("one", 3.0), ("neg", -5.0), ("neg", 5.0), ("inf", float("inf")), ("inf", 1.0), ("inf", 2.0)]
    rows += [("hot", None), ("wide", float("nan")), (None, 1.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = exact_quantiles(df, "v", probs, ("g",))
    for key in ("hot", "wide", "one", "neg", None):
        values = [v for g, v in rows if g == key and v is not None and v == v]
        assert np.allclose(got[(key,)], np.percentile(values, [100 * p for p in probs]), rtol=1e-12)
    assert got[("inf",)][3] == 2.0
    assert exact_quantiles(df.filter("v > 1e300 and v < 1e301"), "v", (0.5,)) == {}


def test_cluster_ranking_differs_for_other_k(spark):
    assert [U.rank_severity(i, 4, FULL) for i in range(4)] == [1, 2, 3, 4]
    assert [U.rank_severity(i, 3, FULL) for i in range(3)] == [1, 2, 4]
    assert [U.rank_severity(i, 3, CPU) for i in range(3)] == [1, 3, 4]
    df = spark.createDataFrame([(0, None), (2, 5.0), (3, 1.0)], "cluster int, resolution_hours double")
    assert U.rank_clusters(df, FULL) == {0: (0.0, 1), 3: (1.0, 2), 2: (5.0, 4)}
    assert set(U.rank_clusters(df, CPU, k=4)) == {0, 1, 2, 3}


def test_fusion_ties_follow_doubles(spark):
    levels = [(a, b, c, d) for a in range(1, 5) for b in range(1, 5) for c in range(1, 5) for d in range(1, 5)]
    df = spark.createDataFrame(
        levels, "severity_llm int, severity_resolution int, severity_rules int, severity_cluster int")
    got = df.select("*", G.fused_level(FULL.fusion).alias("f")).collect()
    for r in got:
        a, b, c, d, f = r
        assert f == max(1, min(4, round(0.4 * a + 0.3 * b + 0.2 * c + 0.1 * d)))


def test_kappa_of_equal_constants_is_nan(spark):
    df = spark.createDataFrame([(2, 2, 2, 2, 2)] * 3,
                               "severity_resolution int, severity_rules int, severity_cluster int, "
                               "severity_fused int, priority_numeric int")
    row = G.signal_agreement(df, CPU).first()
    assert row["cohen_kappa"] != row["cohen_kappa"] and row["raw_agreement"] == 1.0


@pytest.mark.parametrize("answer,want", [
    ('```json\n{"severity": 9, "reason": "x"}\n```', (4, "x")), ('{"severity": "2"}', (2, "")),
    ('{"reason": "r"}', (2, "r")), ("{}", None), ("no", None), ('{"severity": "high"}', None),
    ('{"severity": 3.9, "reason": "a"} {"severity": 1}', (3, "a")), ("{'severity': 1}", None),
])
def test_answer_parsing(spark, answer, want):
    got = spark.createDataFrame([(answer,)], "a string").select(Z.parse_answer(F.col("a"))).first()[0]
    assert (None if got is None else tuple(got)) == want


def test_failing_scorer_falls_back(spark, sf_dir):
    def broken():
        def run(prompts):
            raise RuntimeError("model is gone")
        return run
    df = canonical(spark, sf_dir, FULL).limit(20)
    got = Z.score_with(df, broken).select("ticket_id", "severity_llm").collect()
    want = Z.score_heuristic(df).select("ticket_id", "severity_llm").collect()
    assert sorted(got) == sorted(want)


def test_class_codes_equal_encoder(spark, sf_dir):
    df = canonical(spark, sf_dir)
    table = {r["label"]: r["code"] for r in class_codes(df, "ticket_type").collect()}
    assert table == {c: i for i, c in enumerate(fit_label_encoder(df, "ticket_type").classes)}


def test_split_shares(spark):
    df = spark.range(20000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    for split in (C.hash_split(df, "id"), C.stratified_split(df, "id", "y")):
        n = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
        assert abs(n["test"] / 20000 - 0.15) < 0.01 and abs(n["validation"] / 20000 - 0.15) < 0.01
    exact = C.stratified_split(df, "id", "y").filter("y = 1 and split = 'test'").count()
    assert abs(exact - 300) <= 1


def test_too_few_rows_use_default_cutoffs(spark, sf_dir):
    df = canonical(spark, sf_dir).limit(20)
    model = fit_resolution(df, CPU)
    assert model.regressor is None
    assert {r[0] for r in model.score(df).select("severity_resolution").collect()} <= {1, 2, 3, 4}


def test_classifier_is_stored_and_deterministic(spark, sf_dir, tmp_path):
    df = labelled(spark, sf_dir)
    model = C.train_classifier(df, trees=3, max_depth=3, max_terms=20)
    assert model.metrics.first()["passed"]
    model.save(str(tmp_path / "m"))
    again = C.MismatchClassifier.load(spark, str(tmp_path / "m"))
    columns = ("ticket_id", "mismatch_confidence")
    a = {tuple(r) for r in model.score(df).select(*columns).collect()}
    b = {tuple(r) for r in again.score(df).select(*columns).collect()}
    assert a == b and all(0 <= p <= 1 for _, p in a)


def test_dossiers_are_json_and_zero_hours_survive(spark):
    df = spark.createDataFrame(
        [("1", "data breach", "revenue impact", "Low", "Phone", "a@corp.com", 0.0),
         ("2", "font", "typo", "Critical", "Web", "a@gmail.com", 1.0)],
        "ticket_id string, subject string, description string, priority string, channel string, "
        "email string, resolution_time double")
    scored, dossiers = P.predict(df, FULL)
    checked = D.validate_dossiers(dossiers)
    rows = {r["ticket_id"]: r for r in checked.collect()}
    assert rows["1"]["is_valid"] and rows["1"]["mismatch_type"] == "Hidden Crisis"
    assert [e["signal"] for e in rows["1"]["feature_evidence"]] == [
        "keyword", "resolution_time", "channel", "customer_tier"]
    assert "only 0.0h — faster" in rows["1"]["feature_evidence"][1]["interpretation"]
    assert rows["2"]["mismatch_type"] == "False Alarm" and rows["2"]["severity_delta"] == "-3"
    text = dossiers.select(F.to_json(F.struct("*"))).collect()
    assert all(json.loads(r[0])["feature_evidence"] for r in text)


# Inputs in the style of hard cases: calm words over a crisis, loud words over trifles.
CASES = [
    ("C1", "Small question", "Our production down state persists and we see data loss.", "Low",
     "Email", "a@big.com", 96.0, 1, "Hidden Crisis"),
    ("C2", "HELP!!!", "Wondering if the font size on my profile page could change, no rush.",
     "Critical", "Phone", "u@gmail.com", 0.5, 1, "False Alarm"),
    ("C3", "Follow-up", "Everyone is locked out, the legal deadline is today.", "Medium", "Email",
     "l@ent.com", 120.0, 1, "Hidden Crisis"),
    ("C4", "Hello", "Thanks for the quick answer.", "Low", "Web", "x@y.org", 2.0, 0, "Consistent"),
    ("C5", "Hello", "Something else", None, None, None, None, 0, "Consistent"),
]


def test_labelled_cases(spark):
    df = spark.createDataFrame(
        CASES, "ticket_id string, ticket_subject string, ticket_description string, ticket_priority string, "
        "ticket_channel string, customer_email string, `resolution_time_(in_hours)` double, "
        "expected_mismatch int, expected_type string")
    df = df.withColumn("ticket_channel", F.coalesce("ticket_channel", F.lit("Email")))
    scored = B.score_cases(df)
    report = B.robustness_report(scored).first()
    assert (report["n_cases"], report["n_correct"], report["passed"]) == (5, 5, True)
    assert all(r["expected_type"] == r["mismatch_type"] for r in B.type_confusion(scored).collect())


def test_filters_do_not_copy_the_rule_expression(spark, sf_dir):
    """A filter on a computed level must stay above the scoring."""
    plan = labelled(spark, sf_dir).filter("severity_rules > 2")._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("array_intersect") == 1


def test_train_and_predict_end_to_end(spark, sf_dir):
    from triagelens.sources.views import tickets

    raw = tickets(spark, sf_dir)
    signals, model, _ = P.train(
        raw, CPU,
        {"resolution_args": {"max_iter": 2, "max_depth": 2, "max_terms": 20},
         "cluster_args": {"restarts": 1, "max_iter": 5}},
        {"trees": 2, "max_depth": 3, "max_terms": 20})
    scored, dossiers = P.predict(raw, CPU, signals, model)
    levels = scored.select("severity_resolution", "severity_cluster", "severity_fused").distinct()
    assert all(1 <= v <= 4 for r in levels.collect() for v in r)
    assert dossiers.count() == scored.filter("mismatch_pred = 1").count()


def test_a_run_is_published_as_one_whole(spark, sf_dir, tmp_path, monkeypatch):
    """A run that is lost between its parts leaves the one before in force."""
    df = labelled(spark, sf_dir)
    model = C.train_classifier(df, trees=2, max_depth=2, max_terms=10)
    signals, path = P.Signals(), str(tmp_path / "runs")
    first = save_run(spark, signals, model, path)

    def lost(self, where):
        raise RuntimeError("the session is lost")

    with monkeypatch.context() as broken:
        broken.setattr(C.MismatchClassifier, "save", lost)
        with pytest.raises(RuntimeError):
            save_run(spark, signals, model, path)
    assert versions(spark, path) == [first]
    model.threshold = 0.61
    second = save_run(spark, signals, model, path)
    assert load_run(spark, path)[1].threshold == 0.61
    assert load_run(spark, path, first)[1].threshold != 0.61 and versions(spark, path) == [first, second]


def test_prompts_are_asked_once(spark, tmp_path):
    """Equal prompts are one question, a lost block is asked again, answered ones are not."""
    rows = [(str(i), f"subject {i % 30}", "text", "Web", "General") for i in range(90)]
    df = spark.createDataFrame(
        rows, "ticket_id string, ticket_subject string, ticket_description string, ticket_channel string, ticket_type string")
    log, answers = tmp_path / "asked", str(tmp_path / "answers")
    log.mkdir()

    def scorer(broken):
        def make():
            def run(prompts):
                if broken and any("subject 7\n" in p or "subject 7 " in p or "subject 7" in p for p in prompts):
                    raise RuntimeError("out of memory")
                for p in prompts:
                    (log / uuid.uuid4().hex).write_text(p)
                return ['{"severity": 3, "reason": "r"}'] * len(prompts)
            return run
        return make

    with pytest.raises(RuntimeError):
        Z.score_stored(df, scorer(True), answers, blocks=4, most_failed=0.0)
    out = Z.score_stored(df, scorer(False), answers, blocks=4).collect()
    assert len(out) == 90 and {(r["severity_llm"], r["answer_source"]) for r in out} == {(3, "model")}
    asked = [f.read_text() for f in log.iterdir()]
    assert len(set(asked)) == 30 and len(asked) < 60
    before = len(asked)
    again = Z.score_stored(df, scorer(True), answers, most_failed=0.0)
    assert again.filter("severity_llm = 3").count() == 90 and len(list(log.iterdir())) == before


def test_template_needs_all_three_columns(spark):
    whole = spark.createDataFrame([("s", "d", "Low")], "`Subject` string, description string, `Priority Level` string")
    assert N.check_template(whole, FULL) is whole
    with pytest.raises(ValueError, match="ticket_description"):
        N.check_template(whole.drop("description"), FULL)


def test_stored_scores_shuffle_no_texts(spark, tmp_path):
    """Only the digest, the fallback and the columns that are asked for cross the join with the answers."""
    long = "word " * 400
    df = spark.createDataFrame([(str(i), f"s {i}", f"{long} {i}", "Web", "General") for i in range(4)],
                               "ticket_id string, ticket_subject string, ticket_description string, ticket_channel string, ticket_type string")

    def unsure():
        return lambda prompts: ["no"] * len(prompts)

    scored = Z.score_stored(df, unsure, str(tmp_path / "answers")).select("ticket_id", "severity_llm", "llm_reason")
    assert sorted(map(tuple, scored.collect())) == sorted(map(tuple, Z.score_heuristic(df).select(*scored.columns).collect()))
    above = scored._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[0]
    assert "ticket_description" not in above
    again = Z.score_stored(df, unsure, str(tmp_path / "answers"))
    assert again.count() == 4 and not list(tmp_path.glob("prompts*"))


def test_grounding_is_judged_once(spark):
    """The texts of a ticket are cut once for the answer and its shown reason."""
    df = spark.createDataFrame([("app is down", "app is down today", 3, "app is down"), ("a", "b", 2, "no such words")],
                               "ticket_subject string, ticket_description string, severity_llm int, llm_reason string")
    found = df.select(D.llm_evidence(stemmed=False).alias("e"))
    assert [r["e"]["grounded"] for r in found.collect()] == [True, False]
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 2


def test_filters_do_not_copy_the_phrase_search(spark, sf_dir):
    """A filter on a computed level stays above the search for phrases, which stands in the plan once."""
    plan = labelled(spark, sf_dir).filter("severity_rules > 2")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [run(lower(") == 1
