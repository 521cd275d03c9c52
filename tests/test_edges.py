"""Large models, odd inputs and agreement of batch and stream."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelens import constants as K
from triagelens.operators import analytics as A
from triagelens.operators import classifier as C
from triagelens.operators import clusters as U
from triagelens.operators import live as V
from triagelens.operators import normalise as N
from triagelens.operators import zero_shot as Z
from triagelens.operators.encoding import fit_label_encoder
from triagelens.operators.quantiles import quantile_table
from triagelens.operators.rules import score_rules
from triagelens.plans import storage
from triagelens.plans.audit import Signals
from triagelens.plans.catalog import canonical
from triagelens.profiles import CPU, FULL, LIVE
from triagelens.streaming.audit import audit_stream, start_audit


def test_twelve_thousand_clusters(spark):
    df = spark.range(24_000).select((F.col("id") % 12_000).cast("int").alias("cluster"),
                                    (F.col("id") % 12_000).cast("double").alias("resolution_hours"))
    ranking = U.cluster_ranking(df, FULL)
    assert ranking.count() == 12_000
    levels = {r["cluster"]: r["severity"] for r in ranking.collect()}
    assert levels[0] == 1 and levels[11_999] == 4 and levels[6_000] == U.rank_severity(6_000, 12_000, FULL)
    scored = U.with_cluster_severity(df.limit(10).withColumn("cluster", F.lit(99_999)), ranking)
    assert {r["severity_cluster"] for r in scored.collect()} == {K.DEFAULT_LEVEL}


def test_three_thousand_labels(spark):
    df = spark.range(3_000).select(F.format_string("label %05d", "id").alias("ticket_type"), "id")
    encoder = fit_label_encoder(df, "ticket_type")
    assert len(encoder.classes) == 3_000
    coded = encoder.add(df, "code").collect()
    assert len(coded) == 3_000 and all(r["code"] == float(r["id"]) for r in coded)
    assert encoder.add(df.limit(1).withColumn("ticket_type", F.lit("new")), "code").first()["code"] == 0.0


def test_class_weights_of_many_classes(spark):
    df = spark.range(3_000).select((F.col("id") % 1_500).alias("label"))
    assert {round(r["weight"], 9) for r in C.with_class_weight(df, "label").collect()} == {1.0}


def test_quantiles_of_a_large_hot_group(spark):
    n = 60_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.rand(4) * 100).alias("v")).persist()
    values = [r["v"] for r in df.collect()]
    probabilities = (0.0, 0.05, 0.25, 0.3333, 0.5, 0.9, 1.0)
    got = quantile_table(df, "v", probabilities).first()
    assert got["n"] == n
    assert np.allclose(got["quantiles"], np.percentile(values, [100 * p for p in probabilities]), rtol=1e-12)


def test_two_hour_columns(spark):
    df = spark.createDataFrame([("s", "High", 5.0, 9.0)],
                               "Subject string, Priority string, resolution_hours double, Resolution_Time_Hours double")
    assert N.normalise(df, FULL).first()["resolution_hours"] == 9.0
    twice = spark.createDataFrame([("a", "b", "High")], "`Subject ` string, subject string, Priority string")
    assert N.normalise(twice, FULL).first()["ticket_subject"] == "a"


def test_equal_tickets_get_different_ids(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([("s", "d", "Low")] * 5, "subject string, description string, priority string").write.parquet(path)
    raw = spark.read.parquet(path)
    assert N.normalise(raw, FULL).select("ticket_id").distinct().count() == 5
    live = V.audit_requests(raw).select("ticket_id").collect()
    assert sorted(r[0] for r in live) == [f"LIVE-00{i}" for i in range(1, 6)]


def test_channel_with_a_tab(spark):
    df = spark.createDataFrame([("a", "data breach", "all users affected", "Phone\t"), ("b", "data breach", "all users affected", "Phone")],
                               "ticket_id string, subject string, description string, channel string")
    rows = score_rules(N.prepare(df.withColumn("priority", F.lit("Low")), FULL), FULL.rules).collect()
    assert rows[0]["rule_raw"] == rows[1]["rule_raw"] > 0


def test_a_broken_model_is_seen(spark, sf_dir):
    def broken():
        def run(prompts):
            raise RuntimeError("no model")
        return run

    df = canonical(spark, sf_dir, FULL).limit(5)
    assert {r["answer_source"] for r in Z.score_with(df, broken).collect()} == {"heuristic"}


def test_stream_in_several_batches_equals_batch(spark, sf_dir, tmp_path):
    """Two files before a stop, two after it; rejects included, no row twice."""
    rows = [(f"T{i}", "outage" if i % 3 else "", "all users down", "Low", float(i % 5 - 2)) for i in range(40)]
    schema = "ticket_id string, ticket_subject string, ticket_description string, ticket_priority string, resolution_hours double"
    source = str(tmp_path / "in")
    os.makedirs(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    for begin in (0, 20):
        for k in (begin, begin + 10):
            spark.createDataFrame(rows[k:k + 10], schema).coalesce(1).write.mode("append").parquet(source)
        start_audit(audit_stream(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint"),
                    available_now=True).awaitTermination()
    batch = audit_stream(spark.createDataFrame(rows, schema))
    columns = batch.columns
    got = spark.read.parquet(str(tmp_path / "out")).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))
    assert {r["outcome"] for r in got.collect()} == {"audited", "rejected"}


def test_unfitted_signals_are_stored(spark, tmp_path):
    storage.save_signals(spark, Signals(llm="heuristic"), str(tmp_path / "s"))
    loaded = storage.load_signals(spark, str(tmp_path / "s"))
    assert (loaded.resolution, loaded.clusters, loaded.llm) == (None, None, "heuristic")


def test_heatmap_of_many_names(spark):
    df = spark.range(5_000).select(F.col("id").cast("string").alias("ticket_type"),
                                   F.col("id").cast("string").alias("ticket_channel"), F.lit(1).alias("severity_delta"))
    assert A.heatmap_cells(df).count() == 5_000
    with pytest.raises(ValueError):
        A.delta_heatmap(df)


@pytest.mark.parametrize("name, size, digest", [
    ("FULL_CRITICAL", 37, "f886be53d9df"), ("FULL_HIGH", 22, "fd39c6c5f570"), ("CPU_CRITICAL", 81, "b9128efd078e"), ("CPU_HIGH", 29, "70e2b66a5f5a"),
    ("CPU_LOW", 35, "2f2bd5e7859f"), ("FULL_NEGATIONS", 17, "4a9f89a99073"), ("CPU_NEGATIONS", 14, "428f58a90026")])
def test_fixed_word_lists(name, size, digest):
    """The oracle imports these lists, so their content is held here by digest."""
    words = getattr(K, name)
    assert len(words) == size
    assert hashlib.md5("|".join(words).encode()).hexdigest()[:12] == digest


def test_hand_computed_rules(spark):
    rows = [("1", "production down", "everything is fine"), ("2", "minor typo", "in the footer"), ("3", "question", "nothing else")]
    df = spark.createDataFrame([(*r, "High") for r in rows],
                               "ticket_id string, subject string, description string, priority string")
    got = {r["ticket_id"]: r["severity_rules"] for r in score_rules(N.prepare(df, FULL), FULL.rules).collect()}
    assert got["1"] >= 3 and got["2"] == 1 and got["3"] in (1, 2)
    assert LIVE.name == "live" and CPU.name == "cpu"
