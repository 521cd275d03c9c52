"""Spelling variants: words one edit apart, found by walking a trie as a relation.

The words are put into two compressed tries, one of the words and one of the reversed words.
A trie is a table of edges (node, label, child); nodes are digests of prefixes, so the edges
come from aggregations over prefixes and no task holds a trie.  The frontier is a table of
states (word, what is left of it, node, edits).  Level by level it is joined with the edges
that leave its nodes: an edge is followed exactly, or with the one edit inside its label.  A
one-edit state that ends where a word ends is a neighbour.

One edit lies in the first or in the second half of a word.  So each word starts in either
trie at the last node of its first half and spends its edit behind it, where nodes have few
edges; the two tries together see every edit.  A node has at most as many edges as there are
letters, so a level grows with the states, not with the square of a group of words.

Defined cases: a missing text has no words; a missing key is an empty string before the
colon; repeated rows count again; equal counts go to the smallest word in code-point order; an
empty table, or one without words, gives an empty table; other columns are not read.  Words
may have any length: a long word is a few edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from triagelens.llm.common import lower_ascii, scratch, stored, whole

#: Fixed values of the contract.
RUN = "[A-Za-zÀ-ÿ]+"
DAMAGED = 97
SHORTEST = 5
LEAST = 3
RATIO = 2


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST,
                least: int = LEAST) -> DataFrame:
    """``(word, n)``: lower-cased runs of letters, some of them with one letter deleted."""
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("d"),
                       F.explode(F.regexp_extract_all(lower_ascii(whole(F.col(text))), F.lit(RUN), 0)).alias("r"))
    size, h = F.length("r"), F.crc32(F.concat("d", F.lit(":"), "r"))
    spot = (h % size).cast("int")
    damaged = F.concat(F.substring("r", F.lit(1), spot), F.substring(F.col("r"), spot + 2, size))
    word = F.when(h % DAMAGED == 0, damaged).otherwise(F.col("r"))
    return (runs.filter(size >= shortest).select(word.alias("word")).filter(F.length("word") >= shortest)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least))


@F.pandas_udf(ArrayType(LongType()))
def prefix_digests(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Digests of the prefixes of each word, from the empty one to the whole word.

    A prefix is the sum of its letters, each times the power of its position, so all prefixes
    of all words of a batch come from one running sum.
    """
    factor = np.uint64(0x9E3779B97F4A7C15)
    for words, salts in parts:
        if not len(words):
            yield pd.Series([], dtype=object)
            continue
        sizes = words.str.len().to_numpy()
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        place = np.arange(len(codes)) - np.repeat(begins, sizes)
        powers = np.cumprod(np.full(int(sizes.max()) + 1, factor, np.uint64))
        total = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(codes) * powers[place])])
        salt = salts.to_numpy().astype(np.uint64)
        made = []
        for b, e, s in zip(begins, ends, salt, strict=True):
            sums = total[b:e + 1] - total[b]
            made.append(_mixed(sums + powers[0] * (np.arange(e - b + 1, dtype=np.uint64) + s)).view(np.int64))
        yield pd.Series(made)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bit(letter: Column) -> Column:
    """One of 64 bits for a letter; several letters may share one."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(letter) % 64)


def trie_paths(words: DataFrame, base: int) -> DataFrame:
    """``(word, n, way, spelt, path)`` for both tries (``way`` 0 and 1).

    ``path`` lists the nodes on the word's way, from the prefix of ``base`` letters to the end:
    depth, digest, whether this word describes the node, whether a word ends there, and the
    letters that follow it as bits.
    """
    both = words.select("word", "n", F.xxhash64("word").alias("id"), F.explode(F.array(
        F.struct(F.lit(0).alias("way"), F.col("word").alias("spelt")),
        F.struct(F.lit(1).alias("way"), F.reverse("word").alias("spelt")))).alias("_w")).select("word", "n", "id", "_w.*")
    digests = both.select("*", prefix_digests("spelt", F.col("way") * 1000003).alias("digests"))
    places = stored(digests, "spelling-digests")
    prefixes = places.select("word", "way", "id", "spelt", F.posexplode("digests").alias("depth", "node")).filter(
        F.col("depth") >= base)
    follows = F.substring(F.col("spelt"), F.col("depth") + 1, F.lit(1))
    lettered = prefixes.select("node", "id", (F.col("depth") == base).alias("first"), F.ascii(follows).alias("code"),
                               F.when(follows != "", _bit(follows)).otherwise(F.lit(0).cast("long")).alias("bit"))
    nodes = lettered.groupBy("node").agg(
        F.min("code").alias("low"), F.max("code").alias("high"), F.min("id").alias("owner"),
        F.min(F.when(F.col("code") == 0, F.col("id"))).alias("ended"),
        F.bit_or("bit").alias("bits"), F.max("first").alias("first")).filter(
        "low = 0 or low <> high or first").select(
        "node", F.coalesce("ended", "owner").alias("owner"), "bits", (F.col("low") == 0).alias("ends"))
    on_path = prefixes.select("word", "way", "id", "depth", "node").join(nodes, "node").select(
        "word", "way", F.struct("depth", "node", (F.col("owner") == F.col("id")).alias("own"), "ends", "bits").alias("at"))
    paths = on_path.groupBy("word", "way").agg(F.sort_array(F.collect_list("at")).alias("path"))
    return places.select("word", "n", "way", "spelt").join(paths, ["word", "way"])


def _written(df: DataFrame, purpose: str) -> str:
    """A table with one folder for each level, so a level reads its own rows only."""
    path = scratch(df.sparkSession, purpose)
    df.write.partitionBy("level").parquet(path)
    return path


def one_edit_pairs(words: DataFrame, base: int = SHORTEST // 2) -> DataFrame:
    """``(word, near, near_n)`` for all pairs of words of ``words`` (word, n) that differ by one
    letter more, less or other; both directions, each once.

    Words must have at least ``2 * base`` letters.
    """
    spark = words.sparkSession
    paths = stored(trie_paths(words, base), "spelling-paths")
    # an edge belongs to its child, and the child to one word
    steps = paths.select("word", "n", "spelt", "path", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("i"))
    a, b = F.get("path", F.col("i") - 1), F.get("path", F.col("i"))
    edges = steps.filter(b["own"]).select(
        (F.col("i") - 1).alias("level"), a["node"].alias("node"), b["node"].alias("child"), b["bits"].alias("bits"),
        F.substring(F.col("spelt"), a["depth"] + 1, b["depth"] - a["depth"]).alias("label"),
        F.when(b["ends"] & (b["depth"] == F.length("spelt")), F.col("word")).alias("target"),
        F.when(b["ends"] & (b["depth"] == F.length("spelt")), F.col("n")).alias("target_n"))
    half = (F.length("spelt") / 2).cast("int")
    last = F.size(F.filter("path", lambda p: p["depth"] <= half)) - 1
    begin = F.get("path", last)
    starts = paths.select(last.alias("level"), "word", begin["node"].alias("node"), F.lit(0).alias("edits"),
                          F.substring(F.col("spelt"), begin["depth"] + 1, F.length("spelt")).alias("rest"))
    levels = paths.agg(F.max(F.size("path"))).first()[0]
    if levels is None:
        return spark.createDataFrame([], "word string, near string, near_n long")
    edge_path, start_path = _written(edges, "spelling-edges"), _written(starts, "spelling-starts")
    edge_type = "level int, node long, child long, bits long, label string, target string, target_n long"
    start_type = "level int, word string, node long, edits int, rest string"
    frontier, found = None, []
    for level in range(levels - 1):
        at = F.col("level") == level
        states = spark.read.schema(start_type).parquet(start_path).filter(at).drop("level")
        if frontier is not None:
            states = states.unionByName(frontier)
        stepped = stored(_step(states, spark.read.schema(edge_type).parquet(edge_path).filter(at).drop("level")),
                         f"spelling-level-{level}")
        frontier = stepped.filter("goes_on").select("word", "child", "edits", "rest").withColumnRenamed("child", "node")
        found.append(stepped.filter("stops").select("word", "target", "target_n"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    # nodes are digests: the words themselves decide
    return pairs.filter(F.levenshtein("word", "target", 1) == 1).groupBy(
        "word", F.col("target").alias("near")).agg(F.max("target_n").alias("near_n"))


def _step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states after one edge each.

    The edit stands at the first letter that differs, so an edge that the rest of the word
    follows exactly is followed without one.
    """
    rest, label, size = F.col("rest"), F.col("label"), F.length("label")
    joined = states.join(edges, "node").filter(
        (F.col("edits") == 0) | rest.startswith(label))

    def state(edits: int, taken: Column) -> Column:
        return F.struct(F.lit(edits).alias("edits"), F.substring(rest, taken + 1, F.length(rest)).alias("rest"))

    def edited(taken: Column) -> Column:
        """Taking so many letters for the label costs one edit."""
        near = (F.length(rest) >= taken) & (F.levenshtein(F.substring(rest, F.lit(1), taken), label, 1) == 1)
        return F.when(near, state(1, taken))

    ways = F.when(F.col("edits") == 1, F.array(state(1, size))).when(
        rest.startswith(label), F.array(state(0, size))).otherwise(
        F.array(edited(size), edited(size - 1), edited(size + 1)))
    moved = joined.select("word", "child", "bits", "target", "target_n", F.explode(ways).alias("s")).filter(
        "s is not null").select("word", "child", "bits", "target", "target_n", "s.*")
    # with its edit spent, the rest must be followed by its next letter; before, by any
    followed = F.col("bits").bitwiseAND(_bit(F.substring("rest", 1, 1))) != 0
    goes_on = F.when(F.col("edits") == 0, F.col("bits") != 0).otherwise((F.col("rest") != "") & followed)
    stops = F.col("target").isNotNull() & (F.length("rest") + F.col("edits") == 1)
    return moved.withColumns({"goes_on": goes_on, "stops": stops}).filter("goes_on or stops").drop("bits")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``(word, form)`` links that lead upward: pointers are doubled until
    every one has arrived."""
    links = stored(forms.select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = stored(links.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-links")
        if not links.filter("moved").limit(1).count():
            return links.select("word", "root")
        links = links.drop("moved")


def variants(words: DataFrame, base: int = SHORTEST // 2, ratio: int = RATIO) -> DataFrame:
    """Form and root of every word of ``words`` (word, n)."""
    near = one_edit_pairs(words, base).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best"))
    enough = -F.col("best.minus") >= ratio * F.col("n")
    known = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.minus")).alias("form_n")), "spelling-forms")
    ends = roots(known.filter("form is not null"))
    return known.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Words of all documents with their forms, roots and numbers of near words."""
    return variants(stored(word_counts(docs), "spelling-words"))
