"""Removal of long repeated byte strings through threshold-bounded suffix intervals.

Every byte covered by a string of ``LEAST`` bytes that also starts elsewhere goes.

Partition.  The smallest 32-byte gram of a window of ``LEAST`` bytes (by gear hash, the
leftmost among equals) depends on its bytes alone, so equal windows share it.  A text falls
into segments of windows with one such gram; only segments of equal grams can hold equal
windows.  Segments that occur several times as a whole are settled by counting digests.
The different segments of one gram are compared by their text.

Suffix intervals.  The segments of many grams form a block with distinct separators.  From
its suffix order, kept to more than ``LEAST`` symbols, intervals of common prefixes are
extended backward through the Burrows-Wheeler transform, breadth first: level l sets the
common-prefix values l, by increasing value, and the work stops at ``LEAST``.  Neighbours
in suffix order whose value is still unset share ``LEAST`` bytes or more.

Skew.  Copies count as one segment.  A gram with more different text than a block holds is
not put into one task: all its windows are counted by 128-bit digests, spread over tasks.

Defined cases: a missing text is an empty text; nothing is removed from texts shorter than
``LEAST``; rows that repeat a text are copies of each other and lose all of it; missing ids
are allowed; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelens.llm.common import stored, whole
from triagelens.llm.hashing import GEAR, in_groups, mixed, range_digests

LEAST = 400
GRAM = 32
#: Bytes of different segments that one suffix order holds.
BLOCK = 1 << 20


def window_keys(texts: list[bytes], least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Segments of all texts as arrays: number of the text, first window, window count,
    key, digest, and whether more than one place of the gram is meant."""
    before = 0
    for group in in_groups(texts):
        data = np.frombuffer(b"".join(group), dtype=np.uint8)
        begins = np.concatenate([[0], np.cumsum([len(t) for t in group])])
        if len(data) >= least and (found := _segments(data, begins, least)):
            yield (found[0] + before, *found[1:])
        before += len(group)


def _segments(data: np.ndarray, begins: np.ndarray, least: int) -> tuple[np.ndarray, ...] | None:
    h, width = GEAR[data], 1
    while width < GRAM:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, 2 * width
    h = h[GRAM - 1:] * np.uint32(0x9E3779B1)  # by first byte of the gram
    value = ((h ^ (h >> np.uint32(15))).astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    span = least - GRAM + 1
    # smallest value of every ``span`` neighbours, from running minima of blocks
    n = len(value) - span + 1
    padded = np.full(-(-(len(value) + span) // span) * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:len(value)] = value
    rows = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:n], ahead[span - 1:span - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # windows that lie inside one text
    doc = np.repeat(np.arange(len(begins) - 1), np.diff(begins))[:n]
    inside = np.arange(n) + least <= begins[doc + 1]
    windows = np.flatnonzero(inside)
    if not len(windows):
        return None
    at, doc = at[windows], doc[windows]
    places, where = np.unique(at, return_inverse=True)
    keys = range_digests(data, places, places + GRAM)[where]
    new = np.ones(len(windows), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(windows)))
    start = windows[first]
    last = first + count - 1
    digest = range_digests(data, start, start + count - 1 + least)
    d = doc[first]
    return (d, start - begins[d], count, keys[first].view(np.int64), digest.view(np.int64), at[first] != at[last])


def segments(least: int):
    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for d, start, count, key, digest, multi in window_keys([t.encode() for t in part["text"]], least):
                yield pd.DataFrame({"id": part["id"].array.take(d), "hash": part["hash"].to_numpy()[d], "start": start,
                                    "count": count, "key": key, "digest": digest, "multi": multi})

    return find


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first ``depth`` symbols or more; the end counts as smallest."""
    top = int(text.max()) + 2
    bits = max(1, (top - 1).bit_length())
    width = max(1, min(63 // bits, depth))
    n = len(text)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        key <<= np.uint64(bits)
        key[:n - k] += (text[k:] + 1).astype(np.uint64)
    while True:
        order = np.argsort(key)  # equal ones in any order: intervals go by the first symbols
        k = key[order]
        rank = np.zeros(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], (k[1:] != k[:-1]).astype(np.int64)]))
        if width >= depth or rank[order[-1]] == n:
            return order
        key = rank.astype(np.uint64) << np.uint64(32)
        key[:n - width] += rank[width:].astype(np.uint64)
        width *= 2


def long_neighbours(text: np.ndarray, least: int) -> np.ndarray:
    """Positions of ``text`` whose first ``least`` symbols also start elsewhere.

    ``text`` ends in a symbol that stands nowhere else.
    """
    n = len(text)
    order = suffix_order(text, least + 1)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    back = place[order - 1]  # row of the suffix one symbol longer
    letter = text[order]
    unset = np.ones(n + 1, dtype=bool)  # common prefix of a row with the row before
    unset[0] = unset[n] = False
    member = np.zeros(n, dtype=np.int64)
    lows, highs = np.array([0]), np.array([n])
    for _ in range(least):
        sizes = highs - lows
        total = int(sizes.sum())
        if not total:
            break
        offsets = np.repeat(lows - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        rows = back[np.arange(total) + offsets]
        member[rows] = np.repeat(np.arange(1, len(lows) + 1), sizes)
        if total * 8 > n:
            there = np.zeros(n, dtype=bool)
            there[rows] = True
            rows = np.flatnonzero(there)
        else:
            rows = np.sort(rows)
        m, c = member[rows], letter[rows]
        split = (rows[1:] != rows[:-1] + 1) | (m[1:] != m[:-1]) | (c[1:] != c[:-1])
        lows = rows[np.concatenate([[True], split])]
        highs = rows[np.concatenate([split, [True]])] + 1
        fresh = unset[highs]
        unset[highs] = False
        lows, highs = lows[fresh], highs[fresh]
    rows = np.flatnonzero(unset)
    return np.union1d(order[rows], order[rows - 1])


def block_text(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, each followed by a separator of its own; and the starts."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    symbols = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8).astype(np.int64) + len(texts)
    symbols[ends - 1] = np.arange(len(texts))
    return symbols, ends - sizes


def repeats_in_block(least: int):
    def find(block: pd.DataFrame) -> pd.DataFrame:
        texts = block["bytes"].tolist()
        symbols, starts = block_text(texts)
        hit = np.sort(long_neighbours(symbols, least))
        of = np.searchsorted(starts, hit, side="right") - 1
        once = block["copies"].to_numpy()[of] == 1  # the others are settled
        hit, of = hit[once], of[once]
        if not len(hit):
            return pd.DataFrame({"id": [], "hash": [], "start": [], "count": []}).astype(
                {"id": "Int64", "hash": "int64", "start": "int64", "count": "int64"})
        new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (of[1:] != of[:-1])])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(hit)))
        seg = of[first]
        return pd.DataFrame({"id": block["id"].astype("Int64").array.take(seg), "hash": block["hash"].to_numpy()[seg],
                             "start": block["start"].to_numpy()[seg] + hit[first] - starts[seg], "count": count})

    return find


def windows_of(least: int):
    """Two digests of every window of the segments of crowded grams."""
    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for id_, hash_, start, text in zip(part["id"].astype("Int64"), part["hash"], part["start"], part["bytes"], strict=True):
                data = np.frombuffer(text, dtype=np.uint8)
                at = np.arange(len(data) - least + 1)
                one = range_digests(data, at, at + least)
                two = mixed(one ^ range_digests(data ^ np.uint8(0x5A), at, at + least))
                yield pd.DataFrame({"id": pd.array([id_] * len(at), dtype="Int64"), "hash": hash_, "start": start + at,
                                    "one": one.view(np.int64), "two": two.view(np.int64)})

    return find


def cut_out(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The segments that are wanted of every text."""
    for part in parts:
        rows = []
        for id_, hash_, text, wanted in zip(part["id"].astype("Int64"), part["hash"], part["text"], part["wanted"], strict=True):
            data = text.encode()
            for w in wanted:
                rows.append((id_, hash_, w["start"], w["copies"], w["group"], data[w["start"]:w["stop"]]))
        yield pd.DataFrame(rows, columns=["id", "hash", "start", "copies", "group", "bytes"]).astype({"id": "Int64"})


def kept(least: int):
    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for text, spans in zip(part["text"], part["spans"], strict=True):
                data, removed, number, at = text.encode(), 0, 0, 0
                digest = hashlib.sha256()
                stop = -1
                for start, end in sorted((s["start"], s["start"] + s["count"] - 1 + least) for s in
                                         (spans if spans is not None else ())):
                    if start > stop:  # bytes between two spans are kept
                        number += 1
                        digest.update(data[at:start])
                    removed += max(0, end - max(start, at))
                    at = stop = max(at, end)
                digest.update(data[at:])
                rows.append((len(data), removed, number, digest.hexdigest()))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"]).assign(
                doc_id=part["id"].array)[["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]]

    return find


def repeated_windows(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, hash, start, count): runs of windows that also start elsewhere."""
    found = stored(texts.mapInPandas(
        segments(least), "id long, hash long, start long, count long, key long, digest long, multi boolean"), "segments")
    kinds = stored(found.groupBy("key", "digest", "count").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "hash", "start")).alias("one"),
        F.max("multi").alias("multi")), "kinds")
    # every occurrence of a segment that stands in several places
    several = kinds.filter("copies > 1").select("key", "digest", "count")
    settled = found.join(several, ["key", "digest", "count"], "left_semi").select("id", "hash", "start", "count")
    # grams with different segments
    grams = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max("multi").alias("repeats"),
                                     F.sum(F.col("count") + least - 1).alias("size"))
    grams = stored(grams.filter("kinds > 1 or repeats").select("key", "size"), "grams")
    total = grams.agg(F.sum("size")).first()[0] or 0
    blocks = int(total // BLOCK) * 2 + 1
    group = F.when(F.col("size") > BLOCK, F.lit(-1)).otherwise(F.pmod(F.xxhash64("key"), F.lit(blocks)))
    wanted = kinds.join(grams, "key").select(
        F.col("one.id").alias("id"), F.col("one.hash").alias("hash"), F.struct(
            F.col("one.start").alias("start"), (F.col("one.start") + F.col("count") + least - 1).alias("stop"),
            F.col("copies"), group.alias("group")).alias("w"))
    wanted = wanted.groupBy("id", "hash").agg(F.collect_list("w").alias("wanted"))  # parts of one text
    wanted = wanted.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), "wanted")
    cut = (texts.join(stored(wanted, "wanted"), (F.col("hash") == F.col("_hash")) & F.col("id").eqNullSafe(F.col("_id")))
           .select("id", "hash", "text", "wanted")
           .mapInPandas(cut_out, "id long, hash long, start long, copies long, group long, bytes binary"))
    cut = stored(cut, "cut")
    schema = "id long, hash long, start long, count long"
    # rows that repeat id and text give their segments twice: one is enough
    in_blocks = (cut.filter("group >= 0").dropDuplicates(["group", "id", "hash", "start"])
                 .groupBy("group").applyInPandas(repeats_in_block(least), schema))
    crowded = cut.filter("group < 0").dropDuplicates(["id", "hash", "start"]).mapInPandas(
        windows_of(least), "id long, hash long, start long, one long, two long")
    twice = crowded.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    spread = crowded.join(twice, ["one", "two"], "left_semi").select("id", "hash", "start", F.lit(1).cast("long").alias("count"))
    return settled.unionByName(in_blocks).unionByName(spread)


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Key, bytes, removed bytes, removed runs, the digest of what is kept, and whether anything
    was removed."""
    t = whole(F.col(text))
    texts = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(t).alias("hash"), t.alias("text"))
    runs = repeated_windows(texts, least)
    spans = stored(runs.groupBy("id", "hash").agg(F.collect_set(F.struct("start", "count")).alias("spans")).select(
        F.col("id").alias("_id"), F.col("hash").alias("_hash"), "spans"), "spans")
    rows = texts.join(spans, (F.col("hash") == F.col("_hash")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    made = rows.select("id", "text", "spans").mapInPandas(
        kept(least), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return made.withColumnRenamed("doc_id", key).withColumn("changed", F.col("n_removed") > 0)
