"""Quality classifier on random-indexing word vectors.

Every word has a sparse random index vector, drawn from its 64-bit digest.  The vector of
a word is the sum of the index vectors of its neighbours over all documents.  Texts are
read in chunks; a chunk sums up the neighbours of its own words, the sums meet by buckets
of word digests, and every chunk gets the vectors of its words back.  No table of all
words is in one place.  A document is the mean of its words' vectors, with how alike and
how often equal words in a row are, how many different words there are and how long it is.
A two-layer network in numpy learns the labels from a bounded sample, and a temperature,
fitted on labelled documents it has not seen, calibrates its probabilities.

Defined cases: a missing text is an empty text, whose vector is zero and which gets a
score like any other; missing labels are ignored, several labels of a document all count;
labels without a document are ignored; without both labels in the sample every score is
the share of label 1 (0.5 without any label); repeated rows are scored each; extra columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelens.llm.common import stored, whole
from triagelens.llm.hashing import in_groups, mixed, range_digests

SIZE, NEIGHBOURS = 64, 2
#: An index vector has one 1 or -1 in each of these ranges of its places.
BREADTH = np.array([11, 11, 11, 11, 10, 10])
BEGIN = np.cumsum(BREADTH) - BREADTH
#: Bytes of text in a chunk, and words of chunks that a bucket holds about.
CHUNK, WORDS_AT_ONCE = 1 << 25, 1 << 18
#: Words in a row that a task handles at once.
PAIRS_AT_ONCE, TOKENS_AT_ONCE = 1 << 20, 1 << 16
#: Mean vector; likeness of neighbours, equal neighbours, equal words two apart, different
#: words per word, logarithm of the length.
POOLED = SIZE + 5
#: Labelled documents that the network is fitted to at most; the bound holds at any scale.
SAMPLE = 20_000
HIDDEN, ROUNDS, RATE, SHRINK = 32, 400, 0.01, 1e-4
#: Score from which a document is predicted to be good.
GOOD = 0.7

# letters and other scripts, digits, signs; blanks belong to no word
KIND = np.full(256, 3, dtype=np.uint8)
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2
KIND[[32, 9, 10, 11, 12, 13, 0]] = 0
CAPITAL = np.zeros(256, dtype=bool)
CAPITAL[65:91] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def index_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the sparse random index vector of every word, from its digest."""
    drawn = np.stack([mixed(words + np.uint64(k)) for k in range(1, len(BREADTH) + 1)], axis=1)
    places = BEGIN + ((drawn >> np.uint64(8)) % BREADTH.astype(np.uint64)).astype(np.int64)
    return places, 2 * (drawn & np.uint64(1)).astype(np.int64) - 1


def word_digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digest of every word, and the number of words of every text.

    Runs of letters, digits or signs are words; words in capitals are words of their own.
    """
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
    kind = KIND[data]
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts, stops = change[:-1], change[1:]
    word = kind[starts] > 0
    starts, stops = starts[word], stops[word]
    capitals = np.concatenate([[0], np.cumsum(CAPITAL[data])])
    shouted = (capitals[stops] - capitals[starts] > 1).astype(np.uint64)
    digest = mixed(range_digests(LOWER[data], starts, stops) + shouted)
    ends = np.cumsum([len(t) + 1 for t in texts])
    at = np.searchsorted(starts, np.concatenate([[0], ends]))
    return digest, np.diff(at)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as compressed 32-bit integers, byte by byte of all numbers."""
    return zlib.compress(numbers.astype("<i4").reshape(-1).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


def chunked(limit: int):
    """Chunks of about ``limit`` bytes of text: their documents, their distinct words, the
    words of the texts as places in those, and the sum of all index vectors."""

    def chunk(name: int, ids: list, sizes: list, digests: list) -> pd.DataFrame:
        words, at, counts = np.unique(np.concatenate(digests), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # frequent words get small numbers
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        words, counts = words[order], counts[order]
        dims, signs = index_of(words)
        common = np.bincount(dims.ravel(), weights=(signs * counts[:, None]).ravel(), minlength=SIZE)
        return pd.DataFrame({
            "chunk": [name], "doc_ids": [np.concatenate([i.to_numpy(np.int64) for i, _ in ids]).tobytes()],
            "no_ids": [np.concatenate([m.to_numpy(bool) for _, m in ids]).tobytes()],
            "sizes": [np.concatenate(sizes).astype(np.int64).tobytes()], "n_words": [len(words)],
            "words": [words.tobytes()], "tokens": [packed(place[at])], "common": [common]})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = TaskContext.get().partitionId() << 32
        ids, sizes, digests, held = [], [], [], 0
        for part in parts:
            begin = 0
            for group in in_groups([t.encode() for t in part["text"]]):
                some = part.iloc[begin:begin + len(group)]
                begin += len(group)
                found, n = word_digests(group)
                ids.append((some["doc_id"], some["no_id"]))
                sizes.append(n)
                digests.append(found)
                held += sum(map(len, group))
                if held >= limit:
                    yield chunk(name, ids, sizes, digests)
                    name, ids, sizes, digests, held = name + 1, [], [], [], 0
        if ids:
            yield chunk(name, ids, sizes, digests)

    return run


def bucket_of(words: np.ndarray, bits: int) -> np.ndarray:
    return (words >> np.uint64(64 - bits)).astype(np.int64)


def neighbours(bits: int):
    """Sums of the index vectors of the neighbours of every word of a chunk, by buckets of words."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, sizes, words, tokens in zip(part["chunk"], part["sizes"], part["words"], part["tokens"], strict=True):
                sizes, words, tokens = np.frombuffer(sizes, np.int64), np.frombuffer(words, np.uint64), unpacked(tokens)
                dims, signs = index_of(words)
                text = np.repeat(np.arange(len(sizes)), sizes)
                sums = np.zeros(len(words) * SIZE)
                for begin in range(0, len(tokens), PAIRS_AT_ONCE):
                    for k in range(1, NEIGHBOURS + 1):
                        left, right = tokens[begin:begin + PAIRS_AT_ONCE], tokens[begin + k:begin + k + PAIRS_AT_ONCE]
                        same = text[begin + k:begin + k + PAIRS_AT_ONCE] == text[begin:begin + len(right)]
                        left, right = left[:len(right)][same].astype(np.int64), right[same].astype(np.int64)
                        for j in range(dims.shape[1]):
                            for a, b in ((left, right), (right, left)):
                                np.add.at(sums, a * SIZE + dims[b, j], signs[b, j].astype(float))
                sums, bucket = sums.reshape(-1, SIZE), bucket_of(words, bits)
                order = np.argsort(bucket, kind="stable")
                names, at = np.unique(bucket[order], return_index=True)
                split = np.split(order, at[1:]) if len(names) else []
                yield pd.DataFrame({"bucket": names, "chunk": np.full(len(names), name),
                                    "words": [words[o].tobytes() for o in split], "sums": [packed(sums[o]) for o in split]})

    return run


def vectors_of(words: np.ndarray, sums: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Vectors of words in bytes: neighbours without what all words share, and, to keep
    words of like company apart, the word's own index vector."""
    out = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    out = out - (out @ common)[:, None] * common
    dims, signs = index_of(words)
    out[np.arange(len(words))[:, None], dims] += signs / np.sqrt(dims.shape[1])
    return np.rint(out * (127 / np.maximum(np.abs(out).max(axis=1, keepdims=True), 1e-9))).astype(np.int8)


def added(common: np.ndarray):
    """Vectors of the words of a bucket, from the sums of all chunks, for every chunk."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        each = [np.frombuffer(w, np.uint64) for w in rows["words"]]
        words, at = np.unique(np.concatenate(each), return_inverse=True)
        sums = np.zeros((len(words), SIZE))
        ends = np.cumsum([len(w) for w in each])
        for a, b, found in zip(ends - [len(w) for w in each], ends, rows["sums"], strict=True):
            sums[at[a:b]] += unpacked(found).reshape(-1, SIZE)  # a chunk has a word once
        vectors = vectors_of(words, sums, common)
        return pd.DataFrame({"chunk": rows["chunk"].to_numpy(), "bucket": np.full(len(rows), key[0]),
                             "vectors": [vectors[x].tobytes() for x in np.split(at, ends[:-1])]})

    return run


def pooled(bits: int):
    """Vectors of the documents of a chunk."""

    def run(chunk: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        row = chunk.iloc[0]
        sizes, tokens = np.frombuffer(row["sizes"], np.int64), unpacked(row["tokens"])
        words = np.frombuffer(row["words"], np.uint64)
        bucket = bucket_of(words, bits)
        order = np.argsort(bucket, kind="stable")
        vectors = np.zeros((len(words), SIZE), np.float32)
        for b, data in zip(found["bucket"], found["vectors"], strict=True):
            at = order[np.searchsorted(bucket[order], b):np.searchsorted(bucket[order], b, "right")]
            vectors[at] = np.frombuffer(data, np.int8).reshape(-1, SIZE)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        sums = np.zeros((len(sizes), POOLED), np.float32)
        ends = np.cumsum(sizes)
        for i, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
            if b > a:
                w, n = tokens[a:b], b - a
                alike = 0.0
                for begin in range(0, n, TOKENS_AT_ONCE):
                    there = vectors[w[begin:begin + TOKENS_AT_ONCE + 1]]
                    sums[i, :SIZE] += there[:TOKENS_AT_ONCE].sum(axis=0)
                    alike += float(np.einsum("ij,ij->", there[:-1], there[1:]))
                sums[i, :SIZE] /= n
                sums[i, SIZE:] = (alike / n, (w[:-1] == w[1:]).sum() / n, (w[:-2] == w[2:]).sum() / n,
                                  len(np.unique(w)) / n, np.log1p(n) / 10)
        return pd.DataFrame({"doc_id": np.frombuffer(row["doc_ids"], np.int64),
                             "no_id": np.frombuffer(row["no_ids"], bool), "vector": [r.tobytes() for r in sums]})

    return run


def document_vectors(texts: DataFrame, limit: int = CHUNK) -> DataFrame:
    """Id and pooled vector of every document (doc_id, text)."""
    chunks = stored(texts.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")
                    .mapInPandas(chunked(limit), "chunk long, doc_ids binary, no_ids binary, sizes binary, n_words long, "
                                                 "words binary, tokens binary, common array<double>"), "chunks")
    entries = chunks.agg(F.sum("n_words")).first()[0] or 0
    bits = max(4, math.ceil(math.log2(max(1, entries / WORDS_AT_ONCE))))
    common = np.zeros(SIZE)
    for r in chunks.select(F.posexplode("common")).groupBy("pos").agg(F.sum("col").alias("sum")).collect():  # SIZE rows
        common[r["pos"]] = r["sum"]
    common /= max(np.linalg.norm(common), 1e-9)
    words = (chunks.select("chunk", "sizes", "words", "tokens")
             .mapInPandas(neighbours(bits), "bucket long, chunk long, words binary, sums binary")
             .groupBy("bucket").applyInPandas(added(common), "chunk long, bucket long, vectors binary"))
    found = chunks.select("chunk", "doc_ids", "no_ids", "sizes", "words", "tokens").groupBy("chunk").cogroup(
        words.groupBy("chunk")).applyInPandas(pooled(bits), "doc_id long, no_id boolean, vector binary")
    return found.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "vector")


@dataclass
class Network:
    """Two layers; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.inner + self.inner_bias) @ self.outer + self.outer_bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def loss(logit: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logit) - y * logit))


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Network:
    """Train on the rows that are not ``held``, calibrate on those that are."""
    rng = np.random.default_rng(5)
    net = Network(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros((x.shape[1], HIDDEN)), np.zeros(HIDDEN),
                  np.zeros(HIDDEN), 0.0)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        net.outer_bias = 0.0 if not len(y) else (20.0 if share == 1 else -20.0)
        return net
    free = y[~held]
    a, b = (x[~held], free) if len(free) and 0 < free.mean() < 1 else (x, y)
    net.mean, net.scale = a.mean(axis=0), a.std(axis=0) + 1e-3
    net.inner = rng.normal(0, 1 / np.sqrt(x.shape[1]), net.inner.shape)
    net.outer = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN)
    z = (a - net.mean) / net.scale
    weights = [net.inner, net.inner_bias, net.outer, np.array([net.outer_bias])]
    first = [np.zeros_like(w) for w in weights]
    second = [np.zeros_like(w) for w in weights]
    for step in range(1, ROUNDS + 1):
        h = np.tanh(z @ weights[0] + weights[1])
        error = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -40, 40))) - b) / len(b)
        inside = np.outer(error, weights[2]) * (1 - h ** 2)
        slopes = [z.T @ inside, inside.sum(axis=0), h.T @ error, np.array([error.sum()])]
        for w, g, m, v in zip(weights, slopes, first, second, strict=True):
            g = g + SHRINK * w
            m += 0.1 * (g - m)
            v += 0.001 * (g ** 2 - v)
            w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    net.inner, net.inner_bias, net.outer, net.outer_bias = weights[0], weights[1], weights[2], float(weights[3][0])
    if held.any():
        logit = net.logits(x[held])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
        net.temperature = float(min(grid, key=lambda t: loss(logit / t, y[held])))
    return net


def rows_of(vectors: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype=np.float32).reshape(-1, POOLED).astype(float)


def remainder(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                   label: str = "quality") -> DataFrame:
    """Key, fold, score and prediction of every document; labels of fold 2 are not read."""
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), whole(F.col(text)).alias("text"))
    vectors = stored(document_vectors(texts), "vectors")
    marked = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(
        F.col("y").isin(0, 1) & (remainder(F.col("doc_id")) != 2))
    marked = marked.withColumn("place", F.xxhash64("doc_id", "y"))
    known = vectors.join(marked, "doc_id").select("vector", "y", "place")
    # first the hashes alone, then the rows they name
    last = known.select("place").orderBy("place").limit(SAMPLE).agg(F.max("place")).first()[0]
    sample = (known.filter(F.col("place") <= (last if last is not None else 0))
              .orderBy("place", "vector", "y").limit(SAMPLE).toPandas())
    net = fit(rows_of(sample["vector"]), sample["y"].to_numpy(dtype=float),
              (sample["place"].to_numpy(dtype=np.int64) % 5) == 0)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(net.scores(rows_of(part)))

    fold = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False))
    found = vectors.select("doc_id", fold.alias("held_out"), score("vector").alias("score"))
    return found.select(F.col("doc_id").alias(key), "held_out", "score",
                        F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted"))
