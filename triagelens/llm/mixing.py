"""Mixing sources to target weights by weighted sampling (DataFrame functions only).

Targets: sources share all words by weight; no target exceeds ``MOST`` times its source.
With caps c and weights w the result of resharing the excess until none is above is
``min(c, level * w)`` for one water level, found from sums over sources sorted by c / w.

Documents: every document gets the key ``u ** (1 / quality)`` with u drawn from its id,
so that sorting by the key samples in proportion to quality.  A source first takes whole
epochs, then documents in the order of their keys until the budget is used up; the last
one gives as many words as are still wanted.  The running sum of a source is built from
ranges of keys, sized by row counts, so a hot source is spread over many tasks.

Defined cases: a missing text has size 0 and is never taken; a missing source is a source
of its own and sorts last; ties of keys are ordered by id and size, and rows equal in all
of these are interchangeable; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelens.llm.common import stored, whole, words

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MOST = 3
#: A source of n documents is cut into sqrt(n) / RANGE_SHARE ranges of keys: their number
#: and their rows both grow slowly.
RANGE_SHARE = 4


def sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Key, source, size in words and the sampling key of every document."""
    t = whole(F.col(text))
    symbols = F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))
    size = F.size(words(F.col(text))).cast("long")
    found = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(t).alias("digest"),
                        F.inline(F.array(F.struct(size.alias("size"), symbols.alias("symbols")))))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    # key u ** (1 / quality), with quality 1 / (1 + symbols per word)
    worth = 1 + F.col("symbols") / F.greatest("size", F.lit(1))
    return found.select("doc_id", "source", "digest", "size", F.pow(uniform, worth).alias("draw"))


def targets(sizes: DataFrame) -> DataFrame:
    """Target words of every source, from one row per source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)),
                          (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    s = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", MOST * F.col("source_size"))
    before = (Window.orderBy(F.col("cap") / F.col("weight"), "weight", "source")
              .rowsBetween(Window.unboundedPreceding, -1))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (s.withColumn("total", F.sum("source_size").over(everything))
         .withColumn("weights", F.sum("weight").over(everything))
         .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("used", F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = (F.col("total") - F.col("full")) / (F.col("weights") - F.col("used"))
    s = s.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    # the level of the first source that stays below its cap holds for all of those
    s = s.withColumn("level", F.min_by("level", F.struct(F.col("level").isNull(), F.col("cap") / F.col("weight"),
                                                         "weight", "source")).over(everything))
    return s.select("source", "source_size", "source_docs", F.when(
        F.col("level").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return shares(stored(sized(docs, key, text, source).drop("digest"), "sized"))


def shares(base: DataFrame) -> DataFrame:
    """What the mix takes of stored sized rows (doc_id, source, size, draw); other columns
    stay, and are the last to order ties by."""
    more = [c for c in base.columns if c not in ("doc_id", "source", "size", "draw")]
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"),
                                       F.count(F.lit(1)).alias("source_docs"))
    goals = stored(targets(sizes), "targets")
    g = goals.select(F.col("source").alias("_source"), "source_size", "source_docs", "target")
    d = base.join(g, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ranges = F.ceil(F.sqrt("source_docs") / RANGE_SHARE)
    d = d.withColumn("range", F.least(F.floor((1 - F.col("draw")) * ranges), ranges - 1))
    in_range = (Window.partitionBy("source", "range")
                .orderBy(F.col("draw").desc(), "doc_id", "size", *more)
                .rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(in_range), F.lit(0)))
    # one row per source and range
    sums = d.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    over = (Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("source").alias("_source"), F.col("range").alias("_range"),
                       F.coalesce(F.sum("range_size").over(over), F.lit(0)).alias("ahead"))
    d = d.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range")))
    want = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(0).cast("long")
    rest = want - epochs * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("ahead") - F.col("inside"), F.lit(0)), F.col("size"))
    return d.select("doc_id", *more, "size", "source_size", "target",
                    (epochs * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    source: str = "source") -> DataFrame:
    """The mix itself: documents repeated once per epoch, and the partly taken document
    of a source cut to the words it gives (joined by one blank).  Columns as in ``docs``.
    Rows that repeat id, text and source are numbered, and each has a share of its own."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    same = ["_id", "_digest", "_of"]
    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(whole(F.col(text))).alias("_digest"),
                       F.col(source).alias("_of"), F.struct(*columns).alias("_row"))
    copies = Window.partitionBy("doc_id", "digest", "source").orderBy("size")
    base = stored(sized(docs, key, text, source).withColumn("of", F.col("source"))
                  .withColumn("copy", F.row_number().over(copies)), "sized")
    repeated = stored(base.filter("copy = 2").select("doc_id", "digest", "of"), "repeated")
    equal = (F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_digest") == F.col("digest"))
             & F.col("_of").eqNullSafe(F.col("of")))
    if repeated.isEmpty():
        rows = rows.withColumn("_copy", F.lit(1))
    else:  # only repeated rows are moved to be numbered
        more = [F.col(f"_row.`{c}`") for c in docs.columns if c not in (key, text, source)]
        numbers = Window.partitionBy(*same).orderBy(F.to_json(F.struct(F.lit(0), *more)))
        rows = rows.join(repeated, equal, "left_anti").withColumn("_copy", F.lit(1)).unionByName(
            rows.join(repeated, equal, "left_semi").withColumn("_copy", F.row_number().over(numbers)))
    taken = shares(base).filter("taken > 0").select("doc_id", "digest", "of", "copy", "size", "taken")
    found = rows.join(taken, equal & (F.col("_copy") == F.col("copy")))
    whole_copies = F.floor(F.col("taken") / F.col("size")).cast("int")
    part = (F.col("taken") % F.col("size")).cast("int")
    found = found.select("_row", F.explode(F.concat(
        F.array_repeat(F.lit(None).cast("int"), whole_copies),
        F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))).alias("_words"))
    return found.select(*[
        (F.when(F.col("_words").isNull(), F.col(f"_row.`{c}`")).otherwise(
            F.array_join(F.slice(words(F.col(f"_row.`{c}`")), F.lit(1), F.col("_words")), " "))
         if c == text else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         length(coalesce(text, ''))
           - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS symbols
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
         pow((('0x' || substring(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)
             / 4294967296.0, 1 + symbols / greatest(size, 1)) AS draw
  FROM base),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
weighed AS (
  SELECT *, 3 * source_size AS cap,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER ahead, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER ahead, 0)) AS level
  FROM weighed
  WINDOW ahead AS (ORDER BY cap / weight, weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first_level AS (
  SELECT arg_min(level, (cap / weight, weight)) AS level FROM levels WHERE level * weight <= cap),
goals AS (
  SELECT w.source, source_size, least(cap, coalesce(level, cap) * weight)::DOUBLE AS target
  FROM weighed AS w, first_level),
summed AS (
  SELECT k.*, source_size, target, floor(target + 0.5)::BIGINT AS want,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY draw DESC, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM keyed AS k JOIN goals AS g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE
         (want // source_size) * size
         + least(greatest(want % source_size - ahead, 0), size) END::BIGINT AS taken
FROM summed
"""
