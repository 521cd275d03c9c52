"""Document fingerprints from content-defined chunks.

A gear hash over the last 32 bytes marks possible boundaries; chunking is normalised: up
to the normal size only boundaries under the strict mask count, beyond it those under the
loose mask, and a chunk ends at the largest size in any case.  An insertion moves only the
boundaries near it.  A fingerprint is the set of chunk digests, each with its length; the
likeness of a document to another is the share of its set, by length, found in the other.

The arithmetic runs in numpy over many texts at once inside tasks; Spark deals the texts
out by ranges of ids, so that every task sees neighbouring documents in order.

Defined cases: a missing text is an empty text, with the fingerprint "" and likeness 1 to
another empty text and 0 to any other (and a text to an empty one: 0); missing ids sort
last; equal ids are ordered by text; repeated rows are separate documents; extra columns
are ignored; one document follows itself; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelens.llm.common import whole
from triagelens.llm.hashing import AT_ONCE, GEAR, in_groups, range_digests

SMALLEST, NORMAL, LARGEST = 16, 32, 127
STRICT_BITS, LOOSE_BITS = 6, 4
WINDOW = 32
#: Ranges of ids for each shuffle partition.
RANGES_PER_PARTITION = 4

def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash of the 32 bytes that end at each position: five doublings of the window."""
    h, width = np.where(data == 0, np.uint32(0), GEAR[data]), 1  # gaps leave no trace
    while width < WINDOW:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, 2 * width
    return h


def ends_after(data: np.ndarray) -> memoryview:
    """For every position, where a chunk that starts there ends."""
    n, h = len(data), gear(data)
    place = np.arange(n, dtype=np.int32)

    def following(bits: int) -> np.ndarray:
        at = np.where(h >> np.uint32(32 - bits) == 0, place, np.int32(n + LARGEST))
        nearest = np.minimum.accumulate(at[::-1])[::-1]
        return np.concatenate([nearest, np.full(LARGEST + 1, n + LARGEST, np.int32)])

    strict, loose = following(STRICT_BITS), following(LOOSE_BITS)
    strict, loose = strict[SMALLEST - 1:SMALLEST - 1 + n] + 1, loose[NORMAL - 1:NORMAL - 1 + n] + 1
    end = np.where(strict <= place + NORMAL, strict, np.minimum(loose, place + LARGEST))
    return memoryview(end.astype(np.int32))


def chunk_sets(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text the sorted chunk digests (48 bits) and the lengths of the chunks."""
    return [found for group in in_groups(texts) for found in _chunk_sets(group)]


def _chunk_sets(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    gap = bytes(WINDOW)
    data = np.frombuffer(gap + gap.join(texts) + gap, dtype=np.uint8)
    after = ends_after(data)
    starts: list[int] = []
    stops: list[int] = []
    counts = []
    at = WINDOW
    for text in texts:
        stop, before = at + len(text), len(starts)
        i = at
        while i < stop:
            starts.append(i)
            i = after[i]
            if i > stop:
                i = stop
            stops.append(i)
        counts.append(len(starts) - before)
        at = stop + WINDOW
    a, b = np.array(starts, dtype=np.int64), np.array(stops, dtype=np.int64)
    digests = range_digests(data, a, b)
    digests >>= np.uint64(16)
    out, i = [], 0
    for n in counts:
        kept, first = np.unique(digests[i:i + n], return_index=True)
        out.append((kept, (b - a)[i:i + n][first]))
        i += n
    return out


def written(found: tuple[np.ndarray, np.ndarray]) -> str:
    """A fingerprint as text: for each chunk 48 bits of digest and 8 of length, base64."""
    digests, sizes = found
    packed = ((digests << np.uint64(8)) | sizes.astype(np.uint64)).astype(">u8")
    return base64.b64encode(packed.view(np.uint8).reshape(-1, 8)[:, 1:].tobytes()).decode()


def likeness(own: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of ``own`` chunks, by length, that ``other`` has too."""
    if not len(own[0]):
        return float(not len(other[0]))
    if not len(other[0]):
        return 0.0
    at = np.minimum(np.searchsorted(other[0], own[0]), len(other[0]) - 1)
    return float(own[1][other[0][at] == own[0]].sum() / own[1].sum())


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the start of the following text."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


def rows_of(ids: list, texts: list[str]) -> pd.DataFrame:
    """Result rows of all documents but the last, which only follows."""
    changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    data = [t.encode() for t in changed]
    sets = chunk_sets([t.encode() for t in texts])
    new = chunk_sets(data)
    return pd.DataFrame({
        "doc_id": pd.array(ids[:-1], dtype="Int64"),
        "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(t).hexdigest() for t in data],
        "fingerprint": [written(s) for s in sets[:-1]],
        "edited_fingerprint": [written(s) for s in new],
        "near_edited": np.array([likeness(a, b) for a, b in zip(sets, new, strict=False)], dtype=float),
        "near_next": np.array([likeness(a, b) for a, b in zip(sets, sets[1:], strict=False)], dtype=float),
    })


def pieces(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Parts of a batch of about ``AT_ONCE`` characters, each with one row of the next."""
    sizes = batch["text"].str.len().to_numpy(dtype=np.int64)
    marks = np.cumsum(sizes) // AT_ONCE
    begin = 0
    while begin < len(batch) - 1:
        end = max(int(np.searchsorted(marks, marks[begin], side="right")), begin + 1)
        yield batch.iloc[begin:min(end + 1, len(batch))]
        begin = end


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edit with the document that follows in
    descending order of the key; the first follows the last.

    Ids are cut into ranges at approximate quantiles.  The first document of the next
    range is put after each range, one row per range, so that texts move once and every
    range is complete in itself.
    """
    d = docs.select(F.col(key).cast("long").alias("doc_id"), whole(F.col(text)).alias("text"))
    n = RANGES_PER_PARTITION * int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = d.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("c")).first()["c"]
    bounds = np.unique(np.array(cuts or [], dtype=np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        known = ids.fillna(0).astype("int64")
        found = len(bounds) - np.searchsorted(bounds, known, side="left")
        return pd.Series(np.where(ids.isna(), len(bounds) + 1, found)).astype("int32")

    d = d.withColumn("range", range_of("doc_id"))
    # at most one row per range from here
    firsts = d.groupBy("range").agg(F.max("doc_id").alias("first")).collect()
    numbers = sorted(r["range"] for r in firsts)
    if not numbers:
        return d.sparkSession.createDataFrame([], SCHEMA)
    before = dict(zip(numbers, numbers[-1:] + numbers[:-1], strict=True))
    marks = d.sparkSession.createDataFrame(
        [(r["range"], r["first"], before[r["range"]]) for r in firsts], "range int, first long, ahead int")
    heads = (d.join(F.broadcast(marks.withColumnRenamed("range", "_range")),
                    (F.col("range") == F.col("_range")) & F.col("doc_id").eqNullSafe(F.col("first")))
             .groupBy("ahead", "doc_id").agg(F.max("text").alias("text")))
    rows = d.withColumn("follows", F.lit(False)).unionByName(
        heads.select("doc_id", "text", F.col("ahead").alias("range"), F.lit(True).alias("follows")))
    dealt = rows.repartitionByRange("range").sortWithinPartitions(
        "range", "follows", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    return dealt.select("doc_id", "text", "follows").mapInPandas(in_order, SCHEMA)


def in_order(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Result rows of sorted documents; a row that only follows ends its range."""
    held: pd.DataFrame | None = None
    for part in parts:
        rows = part if held is None else pd.concat([held, part], ignore_index=True)
        ends = np.flatnonzero(rows["follows"].to_numpy(dtype=bool))
        begin = 0
        for stop in [*(ends + 1).tolist(), len(rows)]:
            for piece in pieces(rows.iloc[begin:stop]):
                ids = piece["doc_id"]
                yield rows_of([None if pd.isna(x) else int(x) for x in ids], piece["text"].tolist())
            begin = stop if stop < len(rows) or (len(ends) and ends[-1] == len(rows) - 1) else len(rows) - 1
        held = rows.iloc[begin:] if begin < len(rows) else None
