"""TF-IDF with a bounded vocabulary: a shuffle of possible top terms to learn it, none to apply it.

Tokens have two or more word characters; terms are tokens and pairs of neighbouring
tokens.  Term weights are ``(1 + ln tf) * idf`` with ``idf = ln((1+n)/(1+df)) + 1``,
rows have unit length.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from triagelens.functions.text import compute_once
from triagelens.session import shared_dir

# The vocabulary is collected and travels with every task, so it must stay small.
MAX_TERMS = 100_000


def lowered(text: Column) -> Column:
    """What tokens are cut from; empty for a missing text."""
    return F.lower(F.coalesce(text, F.lit("")))


#: Bytes of text that a task cuts at once, about (a longer text is cut alone).
BYTES_AT_ONCE = 4_000_000


@dataclass(frozen=True)
class Tokens:
    """The tokens of some texts, two characters long at least: the number of the text and the word
    of each, and the words that occur."""

    lines: np.ndarray
    codes: np.ndarray
    words: pa.Array

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line, first and second word of all neighbouring tokens."""
        same = np.flatnonzero(self.lines[1:] == self.lines[:-1])
        return self.lines[same], self.codes[same], self.codes[same + 1]


#: Code points where runs of letters, numbers and underscores begin and end, in turn.
WORD_BORDERS = np.flatnonzero(np.diff(np.array(
    [False, *(c == 95 or unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), False])))


def _blanked(text: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with blanks for those of every other character."""
    word = np.repeat(np.arange(len(WORD_BORDERS) + 1) % 2 == 1, np.diff(WORD_BORDERS, prepend=0, append=0x110000))
    out = np.where(word[:256] | (np.arange(256) > 127), np.arange(256), 32).astype(np.uint8)[text]
    for lead, end, size in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3), (0xF0, 0xF8, 4)):
        at = np.flatnonzero((text >= lead) & (text < end))
        point = text[at].astype(np.int64) & (0xFF >> (size + 1))
        for i in range(1, size):
            point = point << 6 | (text[at + i] & 0x3F)
        others = at[~word[point]]
        for i in range(size):
            out[others + i] = 32
    return out


def cut_lines(lines: pa.Array) -> Iterator[Tokens]:
    """The tokens of texts, which are cut slice by slice."""
    sizes = pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    border = np.flatnonzero(np.diff(np.cumsum(sizes) // BYTES_AT_ONCE)) + 1
    for begin, end in zip([0, *border.tolist()], [*border.tolist(), len(lines)], strict=True):
        ends = np.concatenate([[0], np.cumsum(sizes[begin:end])]).astype(np.int32)
        bare = np.zeros(0, np.uint8)
        if ends[-1]:
            whole = pc.cast(lines.slice(begin, end - begin), pa.binary())
            data, start = whole.buffers()[2], np.frombuffer(whole.buffers()[1], np.int32)[whole.offset]
            bare = _blanked(np.frombuffer(data, np.uint8)[start:start + ends[-1]])
        cut = pc.ascii_split_whitespace(pa.StringArray.from_buffers(
            end - begin, pa.py_buffer(ends), pa.py_buffer(bare)))
        found = pc.list_flatten(cut).dictionary_encode()
        line = np.repeat(np.arange(begin, end), pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        codes = found.indices.to_numpy()
        kept = (pc.utf8_length(found.dictionary).to_numpy() >= 2)[codes]
        yield Tokens(line[kept], codes[kept].astype(np.int64), found.dictionary)


class TermFinder:
    """Finds the terms of a list in tokens: words and pairs of words by number."""

    def __init__(self, terms: list[str] | tuple[str, ...], max_n: int):
        parts = [t.split(" ") for t in terms]
        self.n_terms, self.max_n = len(terms), max_n
        self.words = pa.array(sorted({w for p in parts for w in p}), pa.string())
        number = {w: i for i, w in enumerate(self.words.to_pylist())}
        # One more place at the end, where words that are in no term fall.
        self.single = np.full(len(number) + 1, -1, np.int64)
        pairs = []
        for i, p in enumerate(parts):
            if len(p) == 1:
                self.single[number[p[0]]] = i
            elif len(p) == 2:
                pairs.append((number[p[0]] * len(number) + number[p[1]], i))
        self.keys, self.pair_terms = np.array(sorted(pairs), np.int64).reshape(-1, 2).T

    def find(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(line, term, n)`` of the listed terms, by line and term."""
        size = len(self.words)
        own = pc.fill_null(pc.index_in(tokens.words, value_set=self.words), size).to_numpy().astype(np.int64)
        term = self.single[own[tokens.codes]]
        known = term >= 0
        places = [tokens.lines[known] * self.n_terms + term[known]]
        if self.max_n == 2 and len(self.keys):
            lines, a, b = tokens.pairs()
            a, b = own[a], own[b]
            both = np.flatnonzero((a < size) & (b < size))
            key = a[both] * size + b[both]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            listed = self.keys[at] == key
            places.append(lines[both[listed]] * self.n_terms + self.pair_terms[at[listed]])
        place, n = np.unique(np.concatenate(places), return_counts=True)
        return place // max(self.n_terms, 1), place % max(self.n_terms, 1), n


@dataclass(frozen=True)
class TfIdf:
    """A fitted vocabulary: terms in alphabetical order with their idf."""

    vocabulary: tuple[str, ...]
    idf: tuple[float, ...]
    max_n: int

    def found(self, finder: TermFinder, lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the terms of each text end (zero first), the terms, and how often each occurs."""
        per_line = np.zeros(len(lines) + 1, np.int32)
        found = []
        for tokens in cut_lines(lines):
            line, term, n = finder.find(tokens)
            per_line[1:] += np.bincount(line, minlength=len(lines)).astype(np.int32)
            found.append((term, n))
        term, n = (np.concatenate(part) for part in zip(*found, strict=True))
        return np.cumsum(per_line, dtype=np.int32), term.astype(np.int32), n.astype(np.float64)

    def unit_rows(self, finder: TermFinder, lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``found``, with the weights of the terms: rows of unit length."""
        ends, term, n = self.found(finder, lines)
        weight, line = (1.0 + np.log(n)) * np.array(self.idf)[term], np.repeat(np.arange(len(lines)), np.diff(ends))
        return ends, term, weight / np.sqrt(np.bincount(line, weight * weight, len(lines)))[line]

    def _rows(self, text: Column, made: Callable) -> Column:
        """``struct<indices, values>`` of every text, on Arrow batches."""
        finder = []  # made once by each worker

        # No iterator, so that a function of these rows alone runs in the same worker.
        @F.arrow_udf("struct<indices:array<int>,values:array<double>>")
        def run(lines: pa.Array) -> pa.Array:
            if not finder:
                finder.append(TermFinder(self.vocabulary, self.max_n))
            ends, *columns = made(self, finder[0], lines)
            return pa.StructArray.from_arrays(
                [pa.ListArray.from_arrays(pa.array(ends), pa.array(c)) for c in columns], names=["indices", "values"])

        return run(lowered(text))

    def counts(self, text: Column) -> Column:
        """``struct<indices, values>``: the row's own terms and how often each occurs."""
        return self._rows(text, TfIdf.found)

    def vectors(self, df: DataFrame, text: str, output: str) -> DataFrame:
        """The weights as sparse ML vectors, for learners that iterate: written once and read
        back as vectors, whose stored form is a struct of indices and values."""
        from pyspark.ml.linalg import VectorUDT  # here, as workers that only count terms need no learners

        size = max(len(self.vocabulary), 1)
        row = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
                       F.col(output)["indices"].alias("indices"), F.col(output)["values"].alias("values"))
        ready = self.sparse(df, text, output).withColumn(output, row)
        path = shared_dir(df.sparkSession, "tfidf-vectors")
        ready.write.parquet(path)
        schema = StructType([StructField(f.name, VectorUDT() if f.name == output else f.dataType) for f in ready.schema])
        return df.sparkSession.read.schema(schema).parquet(path)

    def sparse(self, df: DataFrame, text: str, output: str) -> DataFrame:
        """Adds the unit-length weights as ``struct<indices, values>``: a row costs its own terms."""
        kind = "struct<indices:array<int>,values:array<double>>"
        if not self.vocabulary:
            return df.withColumn(output, F.struct(F.array().alias("indices"), F.array().alias("values")).cast(kind))
        return df.withColumn(output, self._rows(F.col(text), TfIdf.unit_rows))

    def weights(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """Long form ``(key, term, weight)``, non-zero weights only; no shuffle."""
        if not self.vocabulary:
            return df.select(key, F.lit("").alias("term"), F.lit(0.0).alias("weight")).limit(0)
        counted = df.select(key, self.counts(F.col(text)).alias("__counts"))
        own = F.col("__counts")
        # Terms hold word characters and blanks only, so quoting is enough.
        names = F.expr("array(" + ", ".join(f"'{t}'" for t in self.vocabulary) + ")")
        idf = F.expr("array(" + ", ".join(f"{x!r}D" for x in self.idf) + ")")
        listed = F.zip_with(own["indices"], own["values"], lambda i, tf: F.struct(
            F.get(names, i).alias("term"), ((F.lit(1.0) + F.log(tf)) * F.get(idf, i)).alias("w")))
        # Once per row: the generator below adds a filter on its input, which would
        # otherwise be evaluated again underneath.
        kept = compute_once(counted.select(key, "__counts"), {"kept": listed}).select(key, "kept")
        total = F.aggregate("kept", F.lit(0.0), lambda s, x: s + x["w"] * x["w"])
        # The norm is a column of its own below the generator, else every exploded row
        # would compute it again.
        normed = kept.withColumn("norm", F.sqrt(total))
        return normed.select(key, "norm", F.inline("kept")).select(
            key, "term", (F.col("w") / F.col("norm")).alias("weight")
        )


#: Rows whose most frequent terms set the threshold; they decide the cost, never the result.
HINT_ROWS = 400
#: Different terms that a task counts at once before it hands them on.
TERMS_AT_ONCE = 500_000


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One digest for two, whose order counts."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _cells(digest: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two cells for every term, from independent halves of its digest; ``width`` is a power of two."""
    last = np.uint64(width - 1)
    return ((digest & last).astype(np.int64),
            ((digest >> np.uint64(32)) & last).astype(np.int64) + width)


def _word_digests(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    for batch in batches:
        yield from cut_lines(batch.column(0))


def _counted(tokens: Tokens, max_n: int, possible: np.ndarray | None) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Names, occurrences and lines of the words, and of the pairs, that may be wanted."""
    size = len(tokens.words)
    wanted = np.ones(size, bool)
    if possible is not None:
        digests = _word_digests(tokens.words)
        low, high = _cells(digests, len(possible) // 2)
        wanted = possible[low] & possible[high]
    kept = wanted[tokens.codes]
    parts = [(tokens.lines[kept], tokens.codes[kept], 1)]
    if max_n == 2:
        lines, a, b = tokens.pairs()
        if possible is not None:
            low, high = _cells(_mixed(digests[a], digests[b]), len(possible) // 2)
            kept = possible[low] & possible[high]
            lines, a, b = lines[kept], a[kept], b[kept]
        parts.append((lines, a * size + b, 2))
    for lines, keys, n in parts:
        span = int(lines.max()) + 1 if len(lines) else 1
        places = np.sort(keys * span + lines)
        keys = places // span
        begins = np.flatnonzero(np.diff(keys, prepend=-1))
        found = keys[begins]
        if n == 1:
            names = tokens.words.take(pa.array(found)).to_pylist()
        else:
            names = pc.binary_join_element_wise(
                tokens.words.take(pa.array(found // size)), tokens.words.take(pa.array(found % size)), " ").to_pylist()
        new_line = np.diff(places, prepend=-1) != 0
        spread = np.add.reduceat(new_line.astype(np.int64), begins) if len(begins) else begins
        yield names, np.diff(np.append(begins, len(keys))), spread


def _exact(lines: DataFrame, max_n: int, possible: np.ndarray | None = None) -> DataFrame:
    """Exact ``(term, cf, df)``; with a table of possible cells, of no other terms."""

    def table(total: Counter, spread: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64()),
             pa.array([spread[t] for t in total], pa.int64())], names=["term", "cf", "df"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, spread = Counter(), Counter()
        for tokens in _slices(batches):
            for names, n, rows in _counted(tokens, max_n, possible):
                total.update(dict(zip(names, n.tolist(), strict=True)))
                spread.update(dict(zip(names, rows.tolist(), strict=True)))
                if len(total) > TERMS_AT_ONCE:
                    yield table(total, spread)
                    total, spread = Counter(), Counter()
        yield table(total, spread)

    counted = lines.mapInArrow(partial, "term string, cf long, df long")
    return counted.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def _sketch(lines: DataFrame, max_n: int, hints: list[str], width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, ``(cf, df)`` of the hinted terms, and the count-min sketch of all terms.

    A task gives one row for each of its cells, however many different terms it reads."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = TermFinder(hints, max_n)
        cells, known, rows = np.zeros(2 * width, np.int64), np.zeros((len(hints), 2), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for tokens in cut_lines(batch.column(0)):
                digests = _word_digests(tokens.words)
                for part in _cells(digests, width):
                    np.add.at(cells, part, np.bincount(tokens.codes, minlength=len(digests)))
                if max_n == 2:
                    _, a, b = tokens.pairs()
                    for part in _cells(_mixed(digests[a], digests[b]), width):
                        cells += np.bincount(part, minlength=2 * width)
                _, term, n = finder.find(tokens)
                np.add.at(known, (term, 0), n)
                np.add.at(known, (term, 1), 1)
        out = np.concatenate([cells, known.reshape(-1), [rows]])
        used = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(out[used])], names=["cell", "n"])

    summed = lines.mapInArrow(partial, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * width + 2 * len(hints) + 1, np.int64)
    out[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    return int(out[-1]), out[2 * width:-1].reshape(-1, 2), out[: 2 * width]


def candidate_terms(df: DataFrame, text: str, max_terms: int, min_df: int, max_n: int = 2) -> tuple[int, DataFrame]:
    """Number of rows, and exact counts of every term that may be one of the ``max_terms`` most
    frequent ones with ``min_df`` rows or more.

    The most frequent terms of some rows are counted exactly along with a count-min sketch of
    all terms.  If ``max_terms`` of them qualify, the least of their counts is a lower bound for
    the last place; as a cell never holds less than its terms' counts, a term with a smaller cell
    cannot be kept and is not shuffled.  Otherwise all terms are counted.
    """
    if max_n not in (1, 2):
        raise ValueError("terms are built from one or two tokens")
    lines = df.select(lowered(F.col(text)).alias("w"))
    width = 1 << min(max((64 * max_terms).bit_length(), 16), 21)
    some = _exact(lines.limit(HINT_ROWS), max_n).orderBy(F.desc("cf"), "term").limit(max_terms * 2)
    hints = [r["term"] for r in some.collect()]
    n, exact, cells = _sketch(lines, max_n, hints, width)
    known = np.sort(exact[exact[:, 1] >= min_df, 0])[::-1]
    least = known[max_terms - 1] if 0 < max_terms <= len(known) else 0
    return n, _exact(lines, max_n, cells >= least if least > 1 else None)


def fit_tfidf(
    df: DataFrame, text: str, max_terms: int, min_df: int, max_n: int = 2
) -> TfIdf:
    """Keep the ``max_terms`` most frequent terms found in ``min_df`` or more rows.

    Exact, with ties going to the alphabetically first term; only terms that may be kept are
    shuffled (``candidate_terms``).  Texts are read twice; a missing text counts as a row without terms.
    """
    if max_terms > MAX_TERMS:
        raise ValueError(f"max_terms must not exceed {MAX_TERMS}")
    n, counted = candidate_terms(df, text, max_terms, min_df, max_n)
    kept = counted.filter(F.col("df") >= min_df).orderBy(F.desc("cf"), "term").limit(max_terms).collect()
    chosen = sorted((r["term"], r["df"]) for r in kept)
    return TfIdf(
        tuple(t for t, _ in chosen),
        tuple(math.log((1 + n) / (1 + d)) + 1 for _, d in chosen),
        max_n,
    )
