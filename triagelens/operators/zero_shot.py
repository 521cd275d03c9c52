"""Zero-shot severity signal: prompt, answer parsing, heuristic, scorer hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelens import constants as K
from triagelens.functions.lexicon import rule_text
from triagelens.functions.text import compute_once, find_words, let, snippet, words_found
from triagelens.session import drop_table, shared_dir

# A scorer takes prompts and returns one raw answer (or None) per prompt.
Scorer = Callable[[list[str]], list[str | None]]


def prompt(subject: Column, description: Column, channel: Column, ticket_type: Column) -> Column:
    """The model prompt; subject and description are cut to the model's limits."""
    pieces = K.PROMPT.replace("{{", "\x01").replace("}}", "\x02")
    values = (
        F.substring(subject, 1, K.PROMPT_SUBJECT_CHARS),
        F.substring(description, 1, K.PROMPT_DESCRIPTION_CHARS),
        channel,
        ticket_type,
    )
    out = []
    for i, value in enumerate(values):
        head, pieces = pieces.split(f"{{{i}}}")
        out += [F.lit(head.replace("\x01", "{").replace("\x02", "}")), value]
    out.append(F.lit(pieces.replace("\x01", "{").replace("\x02", "}")))
    return F.concat(*out)


def first_object(answer: Column) -> Column:
    """Text of the first ``{...}`` after code fences are taken off, NULL if none."""
    bare = F.regexp_replace(answer, "```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*?\})", 1), F.lit(""))


def parse_answer(answer: Column) -> Column:
    """``struct<severity int, reason string>``; NULL when the answer is unusable.

    Severity defaults to 2 when absent and is clipped to 1..4.  A severity that is not
    a number, an empty object or broken JSON make the whole answer unusable.
    """
    value = F.try_parse_json(first_object(answer))
    number = F.try_variant_get(value, "$.severity", "string")
    present = number.isNotNull()
    parsed = F.when(number.isin("true", "false"), (number == "true").cast("int")).otherwise(
        F.when(number.rlike(r"^\s*[+-]?\d+(\.\d+)?\s*$"), number.try_cast("double").try_cast("int"))
    )
    severity = F.when(present, parsed).otherwise(F.lit(K.DEFAULT_LEVEL))
    clipped = F.least(F.greatest(severity, F.lit(1)), F.lit(4))
    reason = F.coalesce(F.try_variant_get(value, "$.reason", "string"), F.lit(""))
    usable = value.isNotNull() & severity.isNotNull() & ~F.to_json(value).isin("{}", "null")
    return F.when(usable, F.struct(clipped.alias("severity"), reason.alias("reason")))


HEURISTIC_WORDS = K.HEURISTIC_CRITICAL + K.HEURISTIC_HIGH + K.HEURISTIC_LOW


def heuristic(subject: Column, description: Column, found: Column | None = None) -> Column:
    """``struct<severity int, reason string>`` from substring counts; ``found`` are the words
    of the heuristic that occur, if they are known."""
    original = F.concat(subject, F.lit(" "), description)

    def count(text: Column) -> Column:
        def parts(found: Column) -> Column:
            def of(level: tuple[str, ...]) -> Column:
                return F.size(F.array_intersect(found, F.array(*[F.lit(w) for w in level])))

            grave = F.get(found, F.lit(0))  # in list order: critical words before high ones
            return F.struct(
                of(K.HEURISTIC_CRITICAL).alias("critical"),
                of(K.HEURISTIC_HIGH).alias("high"),
                of(K.HEURISTIC_LOW).alias("low"),
                F.when(grave.isin(*K.HEURISTIC_CRITICAL, *K.HEURISTIC_HIGH),
                       F.call_function("instr", text, grave)).alias("first"),
            )

        return let(words_found(text, HEURISTIC_WORDS) if found is None else found, parts)

    def judge(row: Column) -> Column:
        severity = (
            F.when(row["critical"] >= 2, 4)
            .when((row["critical"] == 1) | (row["high"] >= 2), 3)
            .when(row["high"] == 1, 2)
            .when(row["low"] >= 1, 1)
            .otherwise(K.DEFAULT_LEVEL)
        )
        reason = F.when(row["first"].isNotNull(), snippet(original, row["first"], 20, 50))
        return F.struct(
            severity.alias("severity"),
            reason.otherwise(F.substring(subject, 1, 80)).alias("reason"),
        )

    # The lower-case text and the counts are bound once; each is used many times.
    return let(let(rule_text(subject, description), count), judge)


def _emit(df: DataFrame, scored: Column) -> DataFrame:
    """Severity, reason and, where the scorer says it, ``answer_source``."""
    ready = compute_once(df, {"__scored": scored})
    return ready.withColumns(
        {"severity_llm": F.col("__scored.severity"), "llm_reason": F.col("__scored.reason")}
    ).drop("__scored")


def score_heuristic(df: DataFrame) -> DataFrame:
    subject, description = F.col("ticket_subject"), F.col("ticket_description")
    ready = df.withColumn("__found", find_words(rule_text(subject, description), HEURISTIC_WORDS))
    return _emit(ready, heuristic(subject, description, F.col("__found"))).drop("__found")


def score_proxy(df: DataFrame) -> DataFrame:
    """No model: the rule severity stands in and there is no reason."""
    return df.withColumns({"severity_llm": F.col("severity_rules"), "llm_reason": F.lit("")})


def score_answers(df: DataFrame, answer: Column) -> DataFrame:
    """Severity and reason from a column of raw answers, heuristic where unusable;
    ``answer_source`` tells which, so a broken model is seen."""
    return _first_usable(df, answer, heuristic(F.col("ticket_subject"), F.col("ticket_description")))


def _first_usable(df: DataFrame, answer: Column, fallback: Column) -> DataFrame:
    parsed = compute_once(df, {"__parsed": parse_answer(answer)})
    source = F.when(F.col("__parsed").isNotNull(), "model").otherwise("heuristic")
    return _emit(parsed.withColumn("answer_source", source),
                 F.coalesce(F.col("__parsed"), fallback)).drop("__parsed")


def _asked(make_scorer: Callable[[], Scorer], batch: int):
    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = make_scorer()
        for series in batches:
            prompts = series.tolist()
            answers: list[str | None] = []
            for i in range(0, len(prompts), batch):
                part = prompts[i : i + batch]
                try:
                    answers += scorer(part)
                except Exception:  # a failing batch falls back row by row below
                    answers += [None] * len(part)
            yield pd.Series(answers, dtype=object)

    return ask


def score_with(df: DataFrame, make_scorer: Callable[[], Scorer], batch: int = 64) -> DataFrame:
    """Run a user model over all tickets.

    ``make_scorer`` is called once per task, so a model is loaded once and then fed
    Arrow batches of prompts alone.  Answers are parsed, and failed rows replaced, on the
    JVM side.
    """
    ask = _asked(make_scorer, batch)
    asked = df.withColumn("__answer", ask(prompt(*[
        F.col(c) for c in ("ticket_subject", "ticket_description", "ticket_channel", "ticket_type")])))
    return score_answers(asked, F.col("__answer")).drop("__answer")


def score_stored(df: DataFrame, make_scorer: Callable[[], Scorer], answers: str, blocks: int = 8,
                 batch: int = 64, most_failed: float = 0.5) -> DataFrame:
    """As ``score_with``, with the answers kept in a table: equal prompts are asked once, and
    prompts that have an answer there are not asked again.

    New prompts are asked in ``blocks`` jobs, each of which appends its answers, so a lost session
    costs one block.  Prompts without an answer fall back row by row and are asked again by the
    next run; a block fails when more than ``most_failed`` of its prompts have none.
    """
    spark = df.sparkSession
    parts = [F.substring("ticket_subject", 1, K.PROMPT_SUBJECT_CHARS).alias("s"),
             F.substring("ticket_description", 1, K.PROMPT_DESCRIPTION_CHARS).alias("d"),
             F.col("ticket_channel").alias("c"), F.col("ticket_type").alias("t")]
    digest = F.sha2(prompt(*[F.col(c) for c in ("ticket_subject", "ticket_description", "ticket_channel", "ticket_type")]), 256)
    schema, path = "digest string, answer string", shared_dir(spark, "prompts")
    # What varies between prompts is shuffled; their common words are put around it again behind.
    todo = df.select(digest.alias("digest"), F.struct(*parts).alias("parts"))
    if _has_table(spark, answers):
        new = todo.select("digest").distinct().join(
            spark.read.schema(schema).parquet(answers).select("digest"), "digest", "left_anti").filter("digest IS NOT NULL")
        new.write.parquet(f"{path}-new")
        new = spark.read.schema("digest string").parquet(f"{path}-new")
        blocks = blocks if new.limit(1).count() else 0
        todo = todo.join(new, "digest", "left_semi")
    if blocks:
        todo = todo.groupBy("digest").agg(F.first("parts").alias("parts"))
        todo.withColumn("block", F.pmod(F.xxhash64("digest"), F.lit(blocks)).cast("int")).write.partitionBy(
            "block").parquet(path)
    text = prompt(*[F.col(f"parts.{c}") for c in "sdct"])
    for block in range(blocks):
        part = f"{path}-answers-{block}"
        waiting = spark.read.schema("digest string, parts struct<s:string,d:string,c:string,t:string>, block int").parquet(path)
        waiting.filter(F.col("block") == block).select(
            "digest", _asked(make_scorer, batch)(text).alias("answer")).write.parquet(part)
        made = spark.read.schema(schema).parquet(part)
        failed = made.agg(F.avg(F.col("answer").isNull().cast("double"))).first()[0]
        if failed is not None and failed > most_failed:
            raise RuntimeError(f"{failed:.0%} of the prompts of a block have no answer")
        made.filter(F.col("answer").isNotNull()).write.mode("append").parquet(answers)
    for done in ([path, *(f"{path}-answers-{b}" for b in range(blocks))] if blocks else []):
        drop_table(spark, done)
    found = spark.read.schema(schema).parquet(answers).dropDuplicates(["digest"])
    # The heuristic is made where the texts are, so that they are shuffled only if they are asked for.
    subject, description = F.col("ticket_subject"), F.col("ticket_description")
    ready = df.withColumns({"__digest": digest, "__found": find_words(rule_text(subject, description), HEURISTIC_WORDS)})
    ready = compute_once(ready, {"__fallback": heuristic(subject, description, F.col("__found"))}).drop("__found")
    joined = ready.join(found, F.col("__digest") == F.col("digest"), "left").drop("__digest", "digest")
    return _first_usable(joined, F.col("answer"), F.col("__fallback")).drop("answer", "__fallback")


def _has_table(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def ship_by_value() -> None:
    """Send this package's functions to executors inside the closure, so that they need
    no installed copy."""
    import triagelens

    cloudpickle.register_pickle_by_value(triagelens)


ship_by_value()
