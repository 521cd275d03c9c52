"""Quality rules with verdicts on hosts (DataFrame functions only).

Each document gets counts from its own text, in one pass and without a shuffle.  The
failures are then summed by host (one row per host leaves a task), the host rates are
shrunk with a beta prior fitted to all hosts by the method of moments, and the verdict
on a host is joined back to its documents.

Defined cases: a missing text is an empty text and fails; a missing host is a host of its
own; repeated rows are judged and counted each; extra columns are kept and may bear any
name but those of ``COUNTS``, ``base_failed`` and ``kept``, which are replaced; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelens.llm.common import BLANK_RUN, let, stored, whole, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Own rules: symbols per 100 words, repeated lines per 100 lines with words.
MAX_SYMBOLS, MAX_DUP_LINES = 10, 50
#: A host whose shrunk failure rate is above this loses all its documents.
MAX_HOST_RATE = 0.6
#: Strength of the prior where the rates of hosts do not differ.
EVEN_PRIOR = 10.0


def repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array ``w``.

    Windows are sorted as longs that hold a hash above the position; neighbours of equal
    hash are compared word by word, so a hash alone never makes a repeat.
    """

    def counted(low: Column) -> Column:
        high = F.bitwise_not(low)

        def same(x: Column, y: Column) -> Column:
            i, j = x.bitwiseAND(low).cast("int"), y.bitwiseAND(low).cast("int")
            equal = x.bitwiseAND(high) == y.bitwiseAND(high)
            for k in range(3):
                equal = equal & (F.get(w, i + k) == F.get(w, j + k))
            return F.coalesce(equal, F.lit(False))

        packed = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.coalesce(
                F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
                .bitwiseAND(high).bitwiseOR(i.cast("long")),
                F.lit(0).cast("long"),
            ),
        )
        twice = let(F.sort_array(packed), lambda s: F.filter(
            s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))))
        starts = F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(low)))
        return let(starts, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.when(k == 0, F.lit(3).cast("long")).otherwise(
                F.least(F.lit(3).cast("long"), x - F.get(p, k - 1)))),
            F.lit(0).cast("long"), lambda total, x: total + x))

    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(w)))) - 1
    return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(low, counted))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts, ``base_failed`` and ``own_failed`` to every document."""
    t = whole(F.col(text))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    facts = let(words(F.col(text)), lambda w: let(lines, lambda n: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size(n).cast("long").alias("n_lines"),
        (F.size(n) - F.size(F.array_distinct(n))).cast("long").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"))))
    kept = [F.col(f"`{c}`") for c in docs.columns
            if c not in (*COUNTS, "n_lines", "base_failed", "own_failed", "kept")]
    found = docs.select(*kept, F.inline(F.array(facts)))
    n = F.col("n_words")
    return found.withColumn(
        "base_failed", (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    ).withColumn(
        "own_failed", F.col("base_failed") | (100 * F.col("n_symbols") > MAX_SYMBOLS * n)
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines")))


def host_verdicts(judged: DataFrame, host: str = "source") -> DataFrame:
    """One row per host: documents, failures, the shrunk rate and whether it is bad."""
    hosts = judged.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("host_docs"),
        F.sum(F.col("own_failed").cast("long")).alias("host_failed"))
    hosts = stored(hosts, "hosts")
    rate = F.col("host_failed") / F.col("host_docs")
    moments = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).first()  # one row
    m, v = moments["m"] or 0.0, moments["v"] or 0.0
    strength = m * (1 - m) / v - 1 if 0 < v < m * (1 - m) else EVEN_PRIOR
    shrunk = (F.col("host_failed") + m * strength) / (F.col("host_docs") + strength)
    return (hosts.select("host", "host_docs", "host_failed", shrunk.alias("host_rate"))
            .withColumn("host_bad", F.col("host_rate") > MAX_HOST_RATE))


def with_verdicts(judged: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """Add ``kept``.  The stored verdicts are joined by the planner's choice: their real
    size is known, and a hot host is split by the adaptive skew join."""
    v = verdicts.select(F.col("host").alias("_host"), "host_bad")
    return (judged.join(v, F.col(host).eqNullSafe(F.col("_host")), "left")
            .withColumn("kept", ~(F.col("own_failed") | F.coalesce("host_bad", F.lit(False))))
            .drop("_host", "host_bad"))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source",
                  key: str = "doc_id") -> DataFrame:
    """Key, counts and verdict of every document."""
    judged = stored(measured(docs.select(key, host, text), text)
                    .select(key, host, *COUNTS, "base_failed", "own_failed"), "judged")
    verdicts = stored(host_verdicts(judged, host), "verdicts")
    return with_verdicts(judged, verdicts, host).select(key, *COUNTS, "base_failed", "kept")


def drop_rejected(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that pass, with their own columns and whole texts.

    Texts are not shuffled: the host table is small enough to be sent to them, or the
    planner joins it by host.
    """
    judged = measured(docs.select(host, text), text)
    verdicts = stored(host_verdicts(judged, host), "verdicts")
    marks = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                        F.col(host).alias("_source"), F.col(text).alias("_text"))
    found = with_verdicts(measured(marks, "_text"), verdicts, "_source")
    return found.filter("kept").select("_row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT doc_id, i, (w[i], w[i + 1], w[i + 2]) AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (
  SELECT doc_id, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
facts AS (
  SELECT d.doc_id, source, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM facts),
own AS (
  SELECT *, base_failed OR 100 * n_symbols > 10 * n_words
            OR 100 * n_dup_lines > 50 * n_lines AS own_failed FROM judged),
hosts AS (
  SELECT source, count(*) AS n, sum(own_failed::INT) AS f FROM own GROUP BY source),
prior AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM hosts),
strength AS (
  SELECT m, CASE WHEN v > 0 AND v < m * (1 - m) THEN m * (1 - m) / v - 1 ELSE 10.0 END AS s
  FROM prior),
bad AS (
  SELECT source, (f + m * s) / (n + s) > 0.6 AS host_bad FROM hosts, strength)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (own_failed OR host_bad) AS kept
FROM own JOIN bad ON own.source IS NOT DISTINCT FROM bad.source
"""
