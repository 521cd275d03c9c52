"""Tree ensembles trained on stored parts: boosting with early stopping, and forests.

Features are sparse rows ``struct<indices array<int>, values array<double>>``; what is not
listed is zero.  Training covers every row and has three stages, each stored in the shared folder:

1. the rows with every value replaced once by its bin, in parts of at most ``PART_ROWS`` rows
   whose entries lie cell by cell; the bin edges are quantiles that Spark takes feature by feature;
2. trees, grown level by level from histograms that add up over all parts.  A level is one job,
   whose tasks read the parts one after the other and hand on one histogram each.  While all rows
   are one part, there is nothing to add up and its task grows a whole block of trees, by the
   same steps.  A block leaves its trees, and the parts with the scores after it;
3. the ensemble, a small table.

A training run that is given a ``state`` folder goes on after its last complete block, so a lost
session costs one block.  Boosting ends after ``patience`` trees without gain on the validation
rows and keeps the trees up to the best one.  The trees of a forest need not wait for each other:
groups of them grow side by side, one job per level of a group.

Scoring reads rows where they are, in Arrow batches, and covers every row.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelens.operators.tfidf import TermFinder, TfIdf, lowered
from triagelens.session import drop_table, file_system, shared_dir

#: Rows of a stored part at most, and listed values of it that are added up together.
PART_ROWS, VALUES_AT_ONCE = 8_192, 500_000
#: Trees after which scores are stored anew while a block grows.
TREES_PER_STORE = 10
#: Trees of a forest that share their jobs, and groups of them that grow side by side, at most.
TREES_AT_ONCE, GROUPS_AT_ONCE = 8, 4
#: Bins of a feature that is zero in most rows (a term), and of the others.
TERM_BINS, NUMBER_BINS = 8, 64
#: Added to the weight of a node, so that small nodes are not trusted.
SHRINK = 1.0
#: Rows that are scored together.
AT_ONCE = 1000
BLOCK = "block int, best_loss double, best_tree int, trees long, done boolean, feature array<array<int>>, " \
        "cell array<array<int>>, threshold array<array<double>>, value array<array<double>>, gain array<array<double>>"
PART = "number long, label binary, weight binary, validation binary, scores binary, rows binary, begins binary"


@dataclass(frozen=True)
class Ensemble:
    """Complete binary trees, one row each: node ``i`` has the children ``2i + 1`` (value not
    above the threshold) and ``2i + 2``; a feature of -1 is a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    base: float
    n_features: int
    kind: str  # squared | logistic | forest

    def raw(self, indices: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
        """Sum (mean of a forest) of the leaves' values for each row."""
        used = np.unique(self.feature[self.feature >= 0])
        place = np.full(max(self.n_features, 1), -1, np.int64)
        place[used] = np.arange(len(used))
        trees, nodes = self.feature.shape
        column = np.where(self.feature >= 0, place[self.feature], 0).reshape(-1)
        inner, threshold = (self.feature >= 0).reshape(-1), self.threshold.reshape(-1)
        value, root = self.value.reshape(-1), np.arange(trees, dtype=np.int64) * nodes
        out = np.full(len(indices), self.base)
        for begin in range(0, len(indices), AT_ONCE):
            some = indices[begin:begin + AT_ONCE]
            x = np.zeros((len(some), max(len(used), 1)))
            rows = np.repeat(np.arange(len(some)), [len(i) for i in some])
            cells = place[np.concatenate(some)] if len(rows) else np.zeros(0, np.int64)
            known = cells >= 0
            x[rows[known], cells[known]] = np.concatenate(values[begin:begin + AT_ONCE])[known] if len(rows) else 0
            at = np.zeros((len(some), trees), np.int64)
            row = np.arange(len(some))[:, None]
            for _ in range(int(np.log2(nodes + 1)) - 1):
                node = root + at
                right = x[row, column[node]] > threshold[node]
                at = np.where(inner[node], 2 * at + 1 + right, at)
            leaves = value[root + at]
            out[begin:begin + AT_ONCE] += leaves.mean(axis=1) if self.kind == "forest" else leaves.sum(axis=1)
        return out

    def predict(self, indices: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
        """The expected value, or the probability of class 1."""
        raw = self.raw(indices, values)
        if self.kind == "logistic":
            return 1 / (1 + np.exp(-raw))
        return np.clip(raw, 0, 1) if self.kind == "forest" else raw

    def score(self, features: Column) -> Column:
        @F.arrow_udf("double")
        def run(rows: pa.Array) -> pa.Array:
            indices, values = (pc.struct_field(rows, c) for c in ("indices", "values"))
            ends = np.cumsum(pc.list_value_length(indices).to_numpy(zero_copy_only=False))[:-1]
            return pa.array(self.predict(*(np.split(pc.list_flatten(x).to_numpy(zero_copy_only=False), ends)
                                           for x in (indices, values))))

        return run(features)

    def score_texts(self, tfidf: TfIdf, text: Column, numbers: list[Column]) -> Column:
        """As ``score``, of a text's terms with numbers behind them.  Terms are found, weighed and
        judged where the text is: one worker does it, and no features are sent."""
        n_terms, n = len(tfidf.vocabulary), len(numbers)

        @F.arrow_udf("double")
        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            finder = TermFinder(tfidf.vocabulary, tfidf.max_n)
            for lines, listed in batches:
                ends, term, weight = tfidf.unit_rows(finder, lines) if n_terms else (
                    np.zeros(len(lines) + 1, np.int32), np.zeros(0, np.int32), np.zeros(0))
                behind = np.repeat(ends[1:], n)
                indices = np.insert(term, behind, np.tile(np.arange(n_terms, n_terms + n, dtype=np.int32), len(lines)))
                values = np.insert(weight, behind, pc.list_flatten(listed).to_numpy(zero_copy_only=False))
                cut = (ends[1:] + n * np.arange(1, len(lines) + 1))[:-1]
                yield pa.array(self.predict(np.split(indices, cut), np.split(values, cut)))

        return run(lowered(text), F.array(*[x.cast("double") for x in numbers]))

    def importances(self) -> np.ndarray:
        """Share of each feature in the total gain."""
        inner = self.feature >= 0
        total = np.bincount(self.feature[inner], self.gain[inner], minlength=self.n_features)
        return total / total.sum() if total.sum() > 0 else total

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, *(getattr(self, c)[i].tolist() for c in ("feature", "threshold", "value", "gain")),
                 self.base, self.n_features, self.kind) for i in range(len(self.feature))]
        spark.createDataFrame(rows, "tree int, feature array<int>, threshold array<double>, value array<double>, "
                                    "gain array<double>, base double, n_features int, kind string").coalesce(1).write.mode(
            "overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Ensemble:
        rows = spark.read.parquet(path).orderBy("tree").collect()
        return Ensemble(*(np.array([r[c] for r in rows]) for c in ("feature", "threshold", "value", "gain")),
                        rows[0]["base"], rows[0]["n_features"], rows[0]["kind"])


def with_numbers(terms: Column, n_terms: int, numbers: list[Column]) -> Column:
    """A sparse row of terms with numbers behind them."""
    places = F.array(*[F.lit(n_terms + i) for i in range(len(numbers))])
    return F.struct(F.concat(terms["indices"], places).alias("indices"),
                    F.concat(terms["values"], F.array(*[n.cast("double") for n in numbers])).alias("values"))


# ------------------------------------------------------------------------- bins
@dataclass(frozen=True)
class Bins:
    """Upper edges of each feature's bins, one after the other; the last bin is open."""

    edges: tuple[tuple[float, ...], ...]

    def first_cells(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([len(e) + 1 for e in self.edges])])


def fit_bins(sample: DataFrame, n_terms: int, n_features: int) -> Bins:
    """Quantiles of the listed values of each feature.  Terms have zero as their first edge."""
    listed = sample.select(F.explode(F.arrays_zip("features.indices", "features.values")).alias("x")).select(
        F.col("x.indices").alias("f"), F.col("x.values").alias("v"))
    rows = listed.groupBy("f").agg(F.percentile_approx(
        "v", [i / NUMBER_BINS for i in range(1, NUMBER_BINS)], 10 * NUMBER_BINS).alias("q")).collect()
    found = {r["f"]: r["q"] for r in rows}
    edges = []
    for f in range(n_features):
        q = found.get(f, [])
        if f < n_terms:
            step = NUMBER_BINS // (TERM_BINS - 1)
            q = [0.0, *[v for v in q[step - 1::step] if v > 0]]
        edges.append(tuple(sorted(set(q))))
    return Bins(tuple(edges))


def binned(sample: DataFrame, bins: Bins, base: float = 0.0) -> DataFrame:
    """The rows in parts, each with its rows cell by cell; ``base`` is the score of every row."""
    edges, first = [np.array(e) for e in bins.edges], bins.first_cells()

    def packed(number: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(batches)
        label, weight = (whole[c].to_numpy().astype(np.float64) for c in ("label", "weight"))
        f, v = (pc.list_flatten(whole[c]).to_numpy() for c in ("indices", "values"))
        rows = np.repeat(np.arange(len(label), dtype=np.uint16), pc.list_value_length(whole["indices"]).to_numpy())
        order = np.argsort(f, kind="stable")
        f, v, rows = f[order], np.where(np.isnan(v), -np.inf, v)[order], rows[order]  # not above any edge
        border, codes = np.searchsorted(f, np.arange(len(edges) + 1)), np.zeros(len(f), np.int64)
        for i in np.flatnonzero(np.diff(border)):
            own = slice(border[i], border[i + 1])
            codes[own] = first[i] + np.searchsorted(edges[i], v[own])
        order = np.argsort(codes, kind="stable")
        begins = np.searchsorted(codes[order], np.arange(first[-1] + 1))
        made = (label, weight, whole["validation"].to_numpy().astype(bool), np.full(len(label), base),
                rows[order], begins.astype(np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), *(pa.array([m.tobytes()], pa.binary()) for m in made)], schema=_PART)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, PART_ROWS - n)
                batch, n = batch.slice(some.num_rows), n + some.num_rows
                waiting.append(some)
                if n == PART_ROWS:
                    yield packed(number, waiting)
                    number, waiting, n = number + 1, [], 0
        if waiting:
            yield packed(number, waiting)

    return sample.select("label", "weight", "validation", F.col("features.indices").alias("indices"),
                         F.col("features.values").alias("values")).mapInArrow(parts, PART)


_PART = pa.schema([("number", pa.int64()), *(
    (c, pa.binary()) for c in ("label", "weight", "validation", "scores", "rows", "begins"))])


# ------------------------------------------------------------------------ trees
@dataclass
class Tree:
    """A growing tree.  ``cell`` is the last cell of a split's left side, ``open`` are the nodes
    that may be split, with the sums of their gradients and weights in ``sums``."""

    feature: np.ndarray
    cell: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    open: np.ndarray = field(default_factory=lambda: np.array([0]))

    @staticmethod
    def of_depth(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1, np.int32), np.zeros(n, np.int32), *(np.zeros(n) for _ in range(3)))

    @property
    def levels(self) -> int:
        """How many levels are split so far."""
        inner = np.flatnonzero(self.feature >= 0)
        return int(np.log2(inner[-1] + 1)) + 1 if len(inner) else 0


@dataclass(frozen=True)
class Part:
    """Some binned rows: ``rows[begins[c]:begins[c + 1]]`` are those whose value lies in cell ``c``."""

    number: int
    label: np.ndarray
    weight: np.ndarray
    validation: np.ndarray
    scores: np.ndarray
    rows: np.ndarray
    begins: np.ndarray

    @staticmethod
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
        kinds = (np.float64, np.float64, np.bool_, np.float64, np.uint16, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                number, *others = (column[row] for column in batch.columns)
                yield Part(number.as_py(), *(
                    np.frombuffer(x.as_buffer(), kind) for x, kind in zip(others, kinds, strict=True)))

    def nodes(self, tree: Tree, first: np.ndarray) -> np.ndarray:
        """The node of every row; a row that does not list a feature has its first cell."""
        node = np.zeros(len(self.label), np.int64)
        for level in range(tree.levels):
            right = np.zeros(len(node), bool)
            for n in range(2 ** level - 1, 2 ** (level + 1) - 1):
                if tree.feature[n] >= 0:
                    above = self.rows[self.begins[tree.cell[n] + 1]:self.begins[first[tree.feature[n] + 1]]]
                    right[above[node[above] == n]] = True
            split = (tree.feature[node] >= 0) & (node >= 2 ** level - 1)
            node = np.where(split, 2 * node + 1 + right, node)
        return node

    def sums(self, g: np.ndarray, h: np.ndarray, place: np.ndarray, n_places: int) -> np.ndarray:
        """Sums of ``g`` and ``h`` by place and cell, each place's total behind its cells.  The
        place ``n_places`` stands for rows that do not count."""
        cells = len(self.begins) - 1
        out = np.zeros((2, n_places, cells + 1))
        border = [*np.searchsorted(self.begins, np.arange(0, len(self.rows), VALUES_AT_ONCE)), cells]
        counted = bool((place < n_places).all())
        for low, high in zip(border, border[1:]):
            rows = self.rows[self.begins[low]:self.begins[high]].astype(np.intp)
            key = np.repeat(np.arange(high - low), np.diff(self.begins[low:high + 1]))
            if n_places > 1 or not counted:
                key += np.take(place * (high - low), rows)
            for i, each in enumerate((g, h)):
                found = np.bincount(key, np.take(each, rows), (n_places + 1) * (high - low))
                out[i, :, low:high] = found.reshape(n_places + 1, -1)[:n_places]
        for i, each in enumerate((g, h)):
            out[i, :, cells] = np.bincount(place, each, n_places + 1)[:n_places]
        return out

    def sums_of(self, g: np.ndarray, h: np.ndarray, place: np.ndarray, n_places: int, tried: np.ndarray,
                first: np.ndarray) -> np.ndarray:
        """As ``sums``, for the features ``tried`` at each place: their cells one after the other,
        and the totals of the places at the end."""
        width = np.diff(first)[tried].reshape(-1)
        ends = np.cumsum(width)
        slot = np.full((n_places + 1, len(first) - 1), -1, np.int64)
        np.put_along_axis(slot[:n_places], tried, (ends - width).reshape(tried.shape), axis=1)
        out = np.zeros((2, ends[-1] + n_places))
        some, waiting, n = np.unique(tried), [], 0
        for i, f in enumerate(some):
            waiting.append(f)
            n += self.begins[first[f + 1]] - self.begins[first[f]]
            if n < VALUES_AT_ONCE and i + 1 < len(some):
                continue
            rows = np.concatenate([self.rows[self.begins[first[w]]:self.begins[first[w + 1]]] for w in waiting])
            feature = np.repeat(waiting, [self.begins[first[w + 1]] - self.begins[first[w]] for w in waiting])
            inside = np.concatenate([np.repeat(np.arange(first[w + 1] - first[w]), np.diff(
                self.begins[first[w]:first[w + 1] + 1])) for w in waiting])
            key = slot[place[rows], feature]
            kept = np.flatnonzero(key >= 0)
            key, rows = key[kept] + inside[kept], rows[kept]
            for j, each in enumerate((g, h)):
                out[j, :ends[-1]] += np.bincount(key, each[rows], ends[-1])
            waiting, n = [], 0
        for j, each in enumerate((g, h)):
            out[j, ends[-1]:] = np.bincount(place, each, n_places + 1)[:n_places]
        return out


def _left_sides(sums: np.ndarray, total: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Sums up to each cell of features that lie one after the other, from the sums of the cells.
    Rows that do not list a feature are in its first cell: what is missing to the total.  Every
    feature is added up by itself, so that no rounding is carried on to the next."""
    out, begin = np.empty_like(sums), np.cumsum(width) - width
    for w in np.unique(width):
        those = np.flatnonzero(width == w)
        at = begin[those][:, None] + np.arange(w)
        running = np.cumsum(sums[at], axis=1)
        out[at] = running + (total[those] - running[:, -1])[:, None]
    return out


def _split(tree: Tree, sums: np.ndarray, totals: np.ndarray, feature: np.ndarray, bins: Bins, least: float,
           shrink: float) -> None:
    """Splits the open nodes where it gains most, if it gains.  ``sums`` has the cells of ``feature``
    (open node x feature) one after the other; a side weighs ``least`` at least."""
    first, nodes = bins.first_cells(), tree.open
    if not tree.levels:
        tree.value[nodes] = -totals[0] / np.maximum(totals[1] + shrink, 1e-12)
    tree.open = np.zeros(0, np.int64)
    if not feature.size:
        return
    width = np.diff(first)[feature].reshape(-1)
    own = np.repeat(np.arange(len(nodes)), feature.shape[1])  # the node of each feature tried
    (left_g, left_h), cell_of = (_left_sides(s, t[own], width) for s, t in zip(sums, totals)), np.repeat(own, width)
    total_g, total_h = totals[0][cell_of], totals[1][cell_of]
    right_g, right_h = total_g - left_g, total_h - left_h
    # A side of weight zero may seem to weigh something, as sums are rounded.
    thin = np.minimum(left_h, right_h) < np.maximum(least, 1e-11 * total_h)
    gain = (left_g ** 2 / np.where(thin, 1, left_h + shrink) + right_g ** 2 / np.where(thin, 1, right_h + shrink)
            - total_g ** 2 / np.maximum(total_h + shrink, 1e-12))
    gain[thin] = -np.inf
    begin, following = np.concatenate([[0], np.cumsum(width)]), []
    for i, n in enumerate(nodes.tolist()):
        here = begin[i * feature.shape[1]]
        best = here + int(gain[here:begin[(i + 1) * feature.shape[1]]].argmax())
        if not gain[best] > 1e-9:
            continue
        tried = int(np.searchsorted(begin, best, "right")) - 1
        f, cell = int(feature.reshape(-1)[tried]), best - begin[tried]
        tree.feature[n], tree.cell[n], tree.threshold[n], tree.gain[n] = f, first[f] + cell, bins.edges[f][cell], gain[best]
        for child, (g, h) in ((2 * n + 1, (left_g, left_h)), (2 * n + 2, (right_g, right_h))):
            tree.value[child] = -g[best] / max(h[best] + shrink, 1e-12)
            following.append(child)
    tree.open = np.array(following, dtype=np.int64)


def _places(tree: Tree) -> np.ndarray:
    """By node: its number among the open ones, or how many these are."""
    out = np.full(len(tree.feature), len(tree.open))
    out[tree.open] = np.arange(len(tree.open))
    return out


@dataclass(frozen=True)
class BoostArgs:
    """Everything that decides the result of a boosting run."""

    kind: str = "squared"  # squared | logistic
    trees: int = 200
    depth: int = 5
    step: float = 0.05
    subsample: float = 1.0
    least: float = 1.0
    patience: int = 0  # 0: all trees
    least_gain: float = 1e-4
    block: int = 50
    seed: int = 42


def _base(kind: str, label: float, weight: float) -> float:
    """The score that all rows begin with, from the sums of ``label * weight`` and ``weight``."""
    mean = label / weight if weight > 0 else 0.0
    if kind == "squared":
        return mean
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    return float(np.log(mean / (1 - mean)))


def _loss(kind: str, part: Part, scores: np.ndarray) -> np.ndarray:
    """Sum of the weighted losses of the validation rows, and of their weights."""
    scores, label, weight = (x[part.validation] for x in (scores, part.label, part.weight))
    each = (scores - label) ** 2 if kind == "squared" else np.logaddexp(0, scores) - label * scores
    return np.array([(each * weight).sum(), weight.sum()])


def _after(part: Part, scores: np.ndarray, trees: list[Tree], first: np.ndarray) -> np.ndarray:
    for tree in trees:
        scores = scores + tree.value[part.nodes(tree, first)]
    return scores


def _boost_sums(args: BoostArgs, first: np.ndarray, part: Part, scores: np.ndarray, number: int,
                tree: Tree | None) -> np.ndarray:
    """What a part adds to the loss and, unless there is no tree, to the sums of its open nodes."""
    if tree is None:
        return _loss(args.kind, part, scores)
    member = ~part.validation
    if args.subsample < 1:
        member &= np.random.default_rng([args.seed, number, part.number]).random(len(member)) < args.subsample
    if args.kind == "squared":
        g, h = (scores - part.label) * part.weight, part.weight
    else:
        p = 1 / (1 + np.exp(-scores))
        g, h = (p - part.label) * part.weight, p * (1 - p) * part.weight
    place = np.where(member, _places(tree)[part.nodes(tree, first)], len(tree.open))
    return np.concatenate([_loss(args.kind, part, scores), part.sums(g, h, place, len(tree.open)).reshape(-1)])


#: Sums over all rows: of the trees that are part of the scores, the next one's number, and itself.
Ask = Callable[[list[Tree], int, Tree | None], np.ndarray]


def _grow_block(ask: Ask, args: BoostArgs, bins: Bins, number: int, best: tuple[float, int]) -> tuple:
    """One block: its number, the best loss so far and its tree, how many trees, whether they are
    all, and the block's trees."""
    grown: list[Tree] = []
    begin, end = number * args.block, min((number + 1) * args.block, args.trees)
    cells, patience = int(bins.first_cells()[-1]), args.patience

    def lasting(tree: int, loss: np.ndarray) -> bool:
        """Takes note of the loss after so many trees; whether it is worth going on."""
        nonlocal best, patience
        if not patience or not loss[1] > 0:
            patience = 0
            return True
        mean = float(loss[0] / loss[1])
        if tree == 0 or mean < best[0] - args.least_gain:
            best = (mean, tree)
        return tree - best[1] < patience

    going = True
    for tree in range(begin, end):
        made = Tree.of_depth(args.depth)
        for level in range(args.depth):
            found = ask(grown, tree, made)
            if level == 0:
                going = lasting(tree, found[:2])
            if not going:
                break
            sums = found[2:].reshape(2, len(made.open), cells + 1)
            every = np.tile(np.arange(len(bins.edges)), (len(made.open), 1))
            _split(made, sums[:, :, :cells].reshape(2, -1), sums[:, :, cells], every, bins,
                   args.least if args.kind == "squared" else 1e-3, SHRINK)
            if not len(made.open):
                break
        if not going:
            break
        made.value *= args.step
        grown.append(made)
    if going and patience:
        going = lasting(begin + len(grown), ask(grown, end, None))
    n = begin + len(grown)
    return number, best[0], best[1] if patience else n, n, not going or n >= args.trees, grown


# ------------------------------------------------------------------- training runs
def bounded(df: DataFrame, key: str, fit_rows: int, seed: int = 42) -> DataFrame:
    """About ``fit_rows`` rows, chosen by a hash of the key; all rows while there are fewer.
    No fit of this library uses it: they cover all rows."""
    n = df.count()
    if n <= fit_rows:
        return df
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return df.filter(unit < fit_rows / n)


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    files, where = file_system(spark, f"{path}/_SUCCESS")
    return files.exists(where)


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """Stored parts, dealt to as many tasks as run at once: each hands on one row of sums."""
    return spark.read.schema(PART).parquet(path).coalesce(spark.sparkContext.defaultParallelism)


def _prepared(sample: DataFrame, n_terms: int, n_features: int, state: str, args: dict, kind: str) -> tuple[Bins, dict]:
    """Bins, score at the start and number of parts from the state folder, or made and put there."""
    spark = sample.sparkSession
    if not _written(spark, f"{state}/edges"):
        # Bins and cells read the features, which cost a pass over the texts, from here.
        if not _written(spark, f"{state}/sample"):
            sample.write.mode("overwrite").parquet(f"{state}/sample")
        sample = spark.read.schema(sample.schema).parquet(f"{state}/sample")
        n, label, weight = sample.agg(
            F.count(F.lit(1)), *(F.sum(F.when(~F.col("validation"), x)) for x in (
                F.col("label") * F.col("weight"), F.col("weight")))).first()
        bins, base = fit_bins(sample, n_terms, n_features), _base(kind, label or 0.0, weight or 0.0)
        # Only full parts, but for the last of each task.
        binned(sample.coalesce(max(n // PART_ROWS, 1)), bins, base).write.mode("overwrite").parquet(f"{state}/rows-0000")
        made = {"edges": bins.edges, "args": args, "base": base,
                "parts": spark.read.schema(PART).parquet(f"{state}/rows-0000").count()}
        spark.createDataFrame([(json.dumps(made),)], "state string").coalesce(1).write.mode(
            "overwrite").parquet(f"{state}/edges")
        drop_table(spark, f"{state}/sample")
    made = json.loads(spark.read.parquet(f"{state}/edges").first()["state"])
    if made["args"] != json.loads(json.dumps(args)):
        raise ValueError(f"{state} holds a run with other arguments")
    return Bins(tuple(tuple(e) for e in made["edges"])), made


def _added_up(parts: DataFrame, work: Callable[[Part], np.ndarray]) -> np.ndarray:
    """What ``work`` makes of each part, added up: a task hands on one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in Part.read(batches):
            made = work(part)
            total = made if total is None else np.add(total, made, out=total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return sum(np.frombuffer(r["sums"]) for r in parts.mapInArrow(run, "sums binary").collect())


def _scored(parts: DataFrame, trees: list[Tree], first: np.ndarray) -> DataFrame:
    """The parts with the scores after some more trees."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [_after(p, p.scores, trees, first).tobytes() for p in Part.read(iter([batch]))]
            yield batch.set_column(batch.schema.get_field_index("scores"), "scores", pa.array(scores, pa.binary()))

    return parts.mapInArrow(run, PART)


def _block_here(parts: DataFrame, args: BoostArgs, bins: Bins, number: int, best: tuple[float, int]) -> tuple:
    """A block of trees on one part, whose task needs no other."""
    first = bins.first_cells()

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in Part.read(batches):
            scores, n = part.scores, 0

            def ask(trees: list[Tree], tree: int, made: Tree | None) -> np.ndarray:
                nonlocal scores, n
                scores, n = _after(part, scores, trees[n:], first), len(trees)
                return _boost_sums(args, first, part, scores, tree, made)

            made = _grow_block(ask, args, bins, number, best)
            yield _block_row(made)

    return _block_of(parts.mapInArrow(grow, BLOCK).first())


def _block_row(made: tuple) -> pa.RecordBatch:
    *facts, trees = made
    columns = ([getattr(t, f.name).tolist() for t in trees] for f in list(_BLOCK)[len(facts):])
    return pa.RecordBatch.from_pylist([dict(zip(_BLOCK.names, (*facts, *columns), strict=True))], schema=_BLOCK)


def _block_of(row) -> tuple:
    own = zip(row["feature"], row["cell"], row["threshold"], row["value"], row["gain"], strict=True)
    return (row["block"], row["best_loss"], row["best_tree"], row["trees"], row["done"], [
        Tree(np.array(f, np.int32), np.array(c, np.int32), *(np.array(x) for x in xs)) for f, c, *xs in own])


_BLOCK = pa.schema([
    ("block", pa.int32()), ("best_loss", pa.float64()), ("best_tree", pa.int32()), ("trees", pa.int64()),
    ("done", pa.bool_()), *((c, pa.list_(pa.list_(pa.int32()))) for c in ("feature", "cell")),
    *((c, pa.list_(pa.list_(pa.float64()))) for c in ("threshold", "value", "gain"))])


def _block_of_all(spark: SparkSession, path: str, args: BoostArgs, bins: Bins, number: int,
                  best: tuple[float, int]) -> tuple:
    """A block of trees on all parts: a level is one job.  Scores are stored anew now and then, so
    that a job follows few trees."""
    first, parts, n, older = bins.first_cells(), _parts(spark, path), 0, None

    def ask(trees: list[Tree], tree: int, made: Tree | None) -> np.ndarray:
        nonlocal parts, n, older
        if len(trees) - n >= TREES_PER_STORE:
            newer = f"{path}-{len(trees)}"
            _scored(parts, trees[n:], first).write.mode("overwrite").parquet(newer)
            parts, n = _parts(spark, newer), len(trees)
            if older:
                drop_table(spark, older)
            older = newer
        new = trees[n:]
        return _added_up(parts, lambda part: _boost_sums(args, first, part, _after(part, part.scores, new, first), tree, made))

    block = _grow_block(ask, args, bins, number, best)
    if older:
        drop_table(spark, older)
    return block


def boost(sample: DataFrame, n_terms: int, n_features: int, args: BoostArgs, state: str | None = None) -> Ensemble:
    """Boosted trees on all rows of ``sample`` (label, weight, validation, features).

    ``state`` names the folder of a run; one that was begun there goes on."""
    spark = sample.sparkSession
    state = state or shared_dir(spark, "boosting")
    bins, made = _prepared(sample, n_terms, n_features, state, vars(args) | {"n_features": n_features}, args.kind)
    best, trees = (0.0, 0), []
    for number in range(-(-args.trees // args.block)):
        path, rows = f"{state}/block-{number:04d}", f"{state}/rows-{number:04d}"
        if not _written(spark, path):
            if made["parts"] <= 1:
                block = _block_here(_parts(spark, rows), args, bins, number, best)
            else:
                block = _block_of_all(spark, rows, args, bins, number, best)
            if not block[4]:
                _scored(_parts(spark, rows), block[5], bins.first_cells()).write.mode("overwrite").parquet(
                    f"{state}/rows-{number + 1:04d}")
            spark.createDataFrame(pa.Table.from_batches([_block_row(block)]), BLOCK).coalesce(1).write.mode(
                "overwrite").parquet(path)
        block = _block_of(spark.read.schema(BLOCK).parquet(path).first())
        drop_table(spark, rows)
        trees += block[5]
        best = block[1:3]
        if block[4]:
            break
    kept = trees[:best[1]] or [Tree.of_depth(0)]
    return Ensemble(*(np.array([getattr(t, c) for t in kept]) for c in ("feature", "threshold", "value", "gain")),
                    made["base"], n_features, args.kind)


def _grow_group(parts: DataFrame, numbers: range, bins: Bins, depth: int, seed: int, tried: int) -> list[Tree]:
    """Some trees of a forest, level by level; a node tries features of its own."""
    first, trees = bins.first_cells(), [Tree.of_depth(depth) for _ in numbers]
    for level in range(depth):
        features = [np.argsort(np.random.default_rng([seed, number, level]).random((len(tree.open), len(bins.edges))), axis=1)[:, :tried]
                    for number, tree in zip(numbers, trees, strict=True)]
        growing = [(n, t, f) for n, t, f in zip(numbers, trees, features, strict=True) if len(t.open)]
        if not growing or not tried:
            break

        def sums(part: Part, growing=growing) -> np.ndarray:
            out = []
            for number, tree, feature in growing:
                times = np.random.default_rng([seed, number, part.number]).poisson(1.0, len(part.label))
                h = np.where(part.validation, 0.0, part.weight * times)
                place = np.where(h > 0, _places(tree)[part.nodes(tree, first)], len(tree.open))
                out.append(part.sums_of(-part.label * h, h, place, len(tree.open), feature, first).reshape(-1))
            return np.concatenate(out)

        found, at = _added_up(parts, sums), 0
        for _, tree, feature in growing:
            cells, n = int(np.diff(first)[feature].sum()), len(tree.open)
            own = found[at:at + 2 * (cells + n)].reshape(2, -1)
            at += own.size
            _split(tree, own[:, :cells], own[:, cells:], feature, bins, 1e-9, 0.0)
    return trees


def forest(sample: DataFrame, n_terms: int, n_features: int, trees: int = 500, depth: int = 8, seed: int = 42,
           parts: int = 16, state: str | None = None) -> Ensemble:
    """A random forest on all rows of ``sample`` that are not for validation.

    Each tree sees rows drawn with repetition and, at every node, the square root of the number
    of features.  The trees are dealt to ``parts`` groups at least, which grow side by side.
    """
    spark = sample.sparkSession
    state = state or shared_dir(spark, "forest")
    args = {"trees": trees, "depth": depth, "seed": seed, "parts": parts, "n_features": n_features}
    bins, _ = _prepared(sample, n_terms, n_features, state, args, "squared")
    size = max(1, min(TREES_AT_ONCE, -(-trees // parts)))
    tried = min(max(1, int(n_features ** 0.5)), n_features)

    def grown(begin: int) -> None:
        path, numbers = f"{state}/trees-{begin:06d}", range(begin, min(begin + size, trees))
        if not _written(spark, path):
            made = _grow_group(_parts(spark, f"{state}/rows-0000"), numbers, bins, depth, seed, tried)
            spark.createDataFrame(pa.Table.from_batches([_block_row((begin, 0.0, trees, trees, True, made))]), BLOCK).coalesce(
                1).write.mode("overwrite").parquet(path)

    begins = range(0, trees, size)
    with ThreadPoolExecutor(GROUPS_AT_ONCE) as groups:
        list(groups.map(grown, begins))
    made = [t for b in begins for t in _block_of(spark.read.schema(BLOCK).parquet(f"{state}/trees-{b:06d}").first())[5]]
    return Ensemble(*(np.array([getattr(t, c) for t in made]) for c in ("feature", "threshold", "value", "gain")), 0.0,
                    n_features, "forest")
