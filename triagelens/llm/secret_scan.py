"""Secret scans with linked multipart credentials (DataFrame functions only).

Base kinds are found by pattern in each text.  The method adds kinds whose single parts
prove little: a run of 40 or more mixed letters and digits (``key``) and an address
(``endpoint``).  Parts lie on the axis of their text; a key is reported when an access
identifier lies within ``SCOPE`` characters, an endpoint when both an access identifier
and a key, assignment or hex string do.  The interval join sweeps the parts of a text in
order: each part sees the nearest part of every kind on either side, so no pairs are made.

Texts are not shuffled: a task reduces a text to the lengths of its matches and of the
text between them, and running sums turn these into positions.

Defined cases: a missing text has no spans; repeated rows are separate rows with equal
spans; missing ids are allowed; extra columns are ignored by ``secret_scan`` and kept by
``redacted``; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelens.llm.common import whole


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: Kinds in the order in which equal starts are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "key", "endpoint")
ASSIGN_NO, ACCESS_NO, HEX_NO, KEY_NO, ENDPOINT_NO = range(5)
NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Greedy runs: asking for the length in the pattern finds the same matches.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEY = r"[A-Za-z0-9/+]{40,}"
ENDPOINT = r"https?://[A-Za-z0-9._~:/?#@!&*+,;=%-]+"
PATTERNS = (ASSIGN, ACCESS, HEX, KEY, ENDPOINT)
LEAST_VALUE = 6
#: Characters between linked parts at most.
SCOPE = 300
MASK = "[secret]"


def matches(text: Column, kind: int) -> Column:
    """Array of (kind, number, gap before, length, valid) of the leftmost matches."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if kind == ASSIGN_NO else 0))

    def row(m: Column, i: Column, gaps: Column, value: Column) -> Column:
        valid = F.lit(True)
        if kind == ASSIGN_NO:
            valid = F.length(F.get(value, i)) >= LEAST_VALUE
        elif kind == KEY_NO:
            valid = m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")
        return F.struct(F.lit(kind).alias("kind"), i.alias("number"), F.length(F.get(gaps, i)).alias("gap"),
                        F.length(m).alias("size"), valid.alias("valid"))

    all_rows = F.get(F.transform(
        F.array(F.struct(found.alias("m"), F.split(text, pattern, -1).alias("g"), values.alias("v"))),
        lambda s: F.transform(s["m"], lambda m, i: row(m, i, s["g"], s["v"]))), F.lit(0))
    empty = F.array().cast("array<struct<kind:int,number:int,gap:int,size:int,valid:boolean>>")
    return F.when(text.rlike(pattern), all_rows).otherwise(empty)


def parts(docs: DataFrame, text: str) -> DataFrame:
    """One row per valid match with its span, and one without for each other document.

    Documents are numbered where they are read; the number is used in this job only.
    """
    t = whole(F.col(text))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text]
    found = docs.select(*kept, t.alias("_text"), F.monotonically_increasing_id().alias("_row"))
    found = found.select(*kept, "_row", F.inline_outer(
        F.concat(*[matches(F.col("_text"), k) for k in range(len(KINDS))])))
    so_far = (Window.partitionBy("_row", "kind").orderBy("number")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = found.repartition("_row").withColumn(
        "end", F.sum(F.col("gap") + F.col("size")).over(so_far))
    return found.withColumn("start", F.col("end") - F.col("size")).drop("gap", "size", "number")


def linked(found: DataFrame) -> DataFrame:
    """Add ``reported``: base matches, and weak ones near their complements."""
    forward = (Window.partitionBy("_row").orderBy("start", "kind", "end")
               .rowsBetween(Window.unboundedPreceding, -1))
    backward = (Window.partitionBy("_row").orderBy(F.desc("start"), F.desc("kind"), F.desc("end"))
                .rowsBetween(Window.unboundedPreceding, -1))
    access = F.col("valid") & (F.col("kind") == ACCESS_NO)
    secret = F.col("valid") & F.col("kind").isin(ASSIGN_NO, HEX_NO, KEY_NO)

    def near(which: Column) -> Column:
        before = F.col("start") - F.max(F.when(which, F.col("end"))).over(forward)
        after = F.min(F.when(which, F.col("start"))).over(backward) - F.col("end")
        return F.coalesce(F.least(before, after) <= SCOPE, F.lit(False))

    marked = found.withColumn("near_access", near(access)).withColumn("near_secret", near(secret))
    return marked.withColumn("reported", F.coalesce(F.col("valid"), F.lit(False)) & (
        (F.col("kind") < KEY_NO)
        | ((F.col("kind") == KEY_NO) & F.col("near_access"))
        | ((F.col("kind") == ENDPOINT_NO) & F.col("near_access") & F.col("near_secret"))))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, digest of the base spans and all spans of every document."""
    found = linked(parts(docs.select(key, text), text))
    span = F.when(F.col("reported"), F.struct("start", "kind", "end"))
    per_doc = found.groupBy("_row").agg(
        F.first(key).alias(key), F.sort_array(F.collect_list(span)).alias("all"))

    def number(kind: int) -> Column:
        return F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long")

    return per_doc.select(
        key, number(ASSIGN_NO).alias("n_assign"), number(ACCESS_NO).alias("n_access"),
        number(HEX_NO).alias("n_hex"),
        F.sha2(listed(F.filter("all", lambda s: s["kind"] < KEY_NO)), 256).alias("base_sha256"),
        listed(F.col("all")).alias("spans"))


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with every reported span replaced by ``MASK``; overlapping spans
    become one.  Only the spans of documents that have any are joined to the texts."""
    digest = F.xxhash64(whole(F.col(text)))
    found = linked(parts(docs.select(key, text, digest.alias("_digest")), text)).filter("reported")
    earlier = (Window.partitionBy("_row").orderBy("start", "end")
               .rowsBetween(Window.unboundedPreceding, -1))
    so_far = (Window.partitionBy("_row").orderBy("start", "end")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = (found.withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(earlier), F.lit(-1))).cast("int"))
            .withColumn("run", F.sum("new").over(so_far))
            .groupBy("_row", "run").agg(F.first(key).alias("_key"), F.first("_digest").alias("_digest"),
                                        F.min("start").alias("start"), F.max("end").alias("end"))
            .groupBy("_row").agg(F.first("_key").alias("_key"), F.first("_digest").alias("_digest"),
                                 F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_runs"))
            .groupBy("_key", "_digest").agg(F.first("_runs").alias("_runs")))  # equal rows, equal spans
    t = F.col("_row_of.`" + text + "`")

    def rebuilt(runs: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)["end"].cast("int")
        kept = F.transform(runs, lambda r, i: F.concat(F.substring(
            t, F.coalesce(F.get(runs, i - 1)["end"], F.lit(0)).cast("int") + 1,
            (r["start"] - F.coalesce(F.get(runs, i - 1)["end"], F.lit(0))).cast("int")), F.lit(MASK)))
        return F.concat(F.array_join(kept, ""), F.substring(t, last + 1, F.length(t)))

    rows = docs.select(F.col(key).alias("_id"), digest.alias("_own"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row_of"))
    joined = rows.join(runs, F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_digest")), "left")
    return joined.select(*[
        (F.when(F.col("_runs").isNull(), t).otherwise(rebuilt(F.col("_runs"))) if c == text
         else F.col(f"_row_of.`{c}`")).alias(c) for c in docs.columns])


def _sql() -> str:
    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    rows = " UNION ALL ".join(f"""
  SELECT doc_id, {k} AS kind, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(v) AS v, unnest(g[:len(m)]) AS g
  FROM (SELECT doc_id, regexp_extract_all(t, {quoted(p)}) AS m,
               regexp_extract_all(t, {quoted(p)}, {2 if k == ASSIGN_NO else 0}) AS v,
               string_split_regex(t, {quoted(p)}) AS g FROM d) WHERE len(m) > 0""" for k, p in enumerate(PATTERNS))
    valid = (f"CASE kind WHEN {ASSIGN_NO} THEN length(v) >= {LEAST_VALUE} WHEN {KEY_NO} THEN "
             "regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]') ELSE true END")
    near = (f"EXISTS (SELECT 1 FROM valid AS o WHERE o.doc_id = p.doc_id AND o.kind IN ({{}}) "
            f"AND (o.s, o.kind, o.e) <> (p.s, p.kind, p.e) "
            f"AND greatest(o.s - p.e, p.s - o.e) <= {SCOPE})")
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({rows}),
placed AS (
  SELECT doc_id, kind, m, v, length(m) AS size,
         sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i)::BIGINT AS e FROM m),
valid AS (SELECT doc_id, kind, e - size AS s, e FROM placed WHERE {valid}),
reported AS (
  SELECT doc_id, s, kind, e, {names}[kind + 1] || ':' || s || ':' || e AS name FROM valid AS p
  WHERE kind < {KEY_NO} OR kind = {KEY_NO} AND {near.format(ACCESS_NO)}
     OR kind = {ENDPOINT_NO} AND {near.format(ACCESS_NO)} AND {near.format(f"{ASSIGN_NO}, {HEX_NO}, {KEY_NO}")})
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
       count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(name, ',' ORDER BY s, kind, e) FILTER (kind < {KEY_NO}), '')) AS base_sha256,
       coalesce(string_agg(name, ',' ORDER BY s, kind, e), '') AS spans
FROM d LEFT JOIN reported AS r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""


SQL = _sql()
