"""Small trees and boosted trees over binned rows.

Features are cut into bins once and packed.  A level of a tree (of all classes' trees of a round together) takes one scan,
which adds up histograms of the bins per node, for some features at a time; the best split of each node among these is found
where they are added up, and the driver compares what each group of features has found.  The state
of boosting is the list of trees: row weights and scores are recomputed from it inside each scan.  Every
``REFRESH`` rounds what the trees so far say is put beside the packed rows, made anew from the first
blocks, so a lost block needs only the source and the trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.plans.scans import CHUNK, PackedRows, collect_sums, feature_array, is_complete, map_rows, pack_rows, sum_over_rows

TREE_DEPTH = 3  # at most 8 leaves
BINS = 64
MAX_CLASSES = 1_000
#: Rounds between two updates of what is kept beside the packed rows.
REFRESH = 10
#: Gains are compared to so many digits (as shares of all weight); of equal ones the first feature's lowest cut wins.
GAIN_DIGITS = 9
TINY = float(np.finfo(np.float32).eps)


def bin_edges(rows: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """For each element of the array column ``x``, increasing cuts that are values of it; a value on a cut lies below it."""
    width = rows.select(F.size("x")).first()
    if width is None:
        raise ValueError("no complete rows")
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.get("x", F.lit(i)), shares, 10_000).alias(f"c{i}") for i in range(width[0])]).first()
    return [np.unique(np.array(cuts, float)) for cuts in found]


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(cuts, x[:, i], side="left") for i, cuts in enumerate(edges)], 1).astype("u1")


@dataclass(frozen=True)
class Tree:
    """A complete binary tree of some depth; a node without a split sends everything to the left."""

    features: np.ndarray  # of inner nodes, level by level; -1 is no split
    cuts: np.ndarray  # rows whose bin is at most this go left
    values: np.ndarray  # one row of numbers per leaf

    def nodes(self, codes: np.ndarray, depth: int) -> np.ndarray:
        """Place of every row among the nodes of one level."""
        at = np.zeros(len(codes), "int64")
        rows = np.arange(len(codes))
        for level in range(depth):
            inner = at + (1 << level) - 1
            feature = self.features[inner]
            at = 2 * at + ((feature >= 0) & (codes[rows, np.maximum(feature, 0)] > self.cuts[inner]))
        return at

    def outputs(self, codes: np.ndarray) -> np.ndarray:
        depth = (len(self.features) + 1).bit_length() - 1
        return self.values[self.nodes(codes, depth)]


def histogram(codes: np.ndarray, node: np.ndarray, nodes: int, bins: int, weight: np.ndarray) -> np.ndarray:
    """Sums of ``weight`` per node, feature and bin."""
    p = codes.shape[1]
    total = np.zeros(nodes * p * bins)
    for start in range(0, len(codes), 1 << 15):
        part = slice(start, start + (1 << 15))
        place = (node[part, None] * p + np.arange(p)) * bins + codes[part]
        total += np.bincount(place.ravel(), np.repeat(weight[part], p), minlength=len(total))
    return total.reshape(nodes, p, bins)


def _grown(left: np.ndarray, right: np.ndarray, kind: str) -> np.ndarray:
    """What is to be maximal: purity of classes, or explained squares (channels: rows, sum)."""
    def purity(side):
        if kind == "classes":
            return np.divide((side**2).sum(-1), side.sum(-1), out=np.zeros(side.shape[:-1]), where=side.sum(-1) > 0)
        return np.divide(side[..., 1] ** 2, side[..., 0], out=np.zeros(side.shape[:-1]), where=side[..., 0] > 0)

    return purity(left) + purity(right)


def best_splits(sums: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature and cut of each node, the sums of both sides, and the gain, from sums per (node, feature, bin, channel)."""
    return _compared(sums, kind)[:4]


def _compared(sums: np.ndarray, kind: str) -> tuple[np.ndarray, ...]:
    """What :func:`best_splits` gives, and the rounded shares by which splits are compared."""
    nodes, p, bins, channels = sums.shape
    left = np.cumsum(sums, 2)[:, :, :-1]
    total = sums[:, :1].sum(2, keepdims=True)
    right = total - left
    weight = left.sum(-1) if kind == "classes" else left[..., 0]
    other = right.sum(-1) if kind == "classes" else right[..., 0]
    everything = np.maximum(total.sum(-1) if kind == "classes" else total[..., 0], 1e-300)
    gain = _grown(left, right, kind) - _grown(total, np.zeros_like(total), kind)
    gain = np.where((weight > 1e-12 * everything) & (other > 1e-12 * everything), gain, 0.0).reshape(nodes, -1)
    shares = np.round(gain / everything.reshape(nodes, 1), GAIN_DIGITS)
    best = shares.argmax(1)
    split = shares[np.arange(nodes), best] > 0
    feature, cut = best // (bins - 1), best % (bins - 1)
    sides = np.zeros((nodes, 2, channels))
    for n in range(nodes):
        sides[n, 0] = left[n, feature[n], cut[n]] if split[n] else total[n, 0, 0]
        sides[n, 1] = right[n, feature[n], cut[n]] if split[n] else 0.0
    gained = np.where(split, gain[np.arange(nodes), best], 0.0)
    return np.where(split, feature, -1), np.where(split, cut, 0), sides.reshape(2 * nodes, channels), gained, shares[np.arange(nodes), best]


@dataclass
class BinnedRows:
    """Packed rows with bins, labels 0, 1, ... and what the trees so far say (``state``, made by ``said``)."""

    first: PackedRows
    edges: list[np.ndarray]
    classes: int
    packed: PackedRows = field(init=False)
    bins: int = field(init=False)

    def __post_init__(self) -> None:
        self.packed, self.bins = self.first, 1 + max(len(cuts) for cuts in self.edges)

    def refresh(self, said) -> None:
        """Put ``said(codes, label)`` beside the rows."""
        old, self.packed = self.packed, self.first.with_column("state", lambda b: said(b["codes"], b["label"]))
        if old is not self.first:
            old.unpersist()

    def unpersist(self) -> None:
        self.packed.unpersist()
        self.first.unpersist()


def labelled_rows(df: DataFrame, features: Sequence[str] | str, label: str) -> DataFrame:
    """(x array, label int) of the complete rows."""
    complete = df.where(is_complete(features) & F.col(label).isNotNull())
    return complete.select(feature_array(features).alias("x"), F.col(label).cast("int").alias("label"))


def bin_rows(rows: DataFrame, bins: int = BINS) -> BinnedRows:
    """Bin and pack rows of (x, label)."""
    top = rows.agg(F.max("label"), F.min("label")).first()
    if top[0] is None or not 0 <= top[1] <= top[0] < MAX_CLASSES:
        raise ValueError(f"labels must be 0 .. {MAX_CLASSES - 1}")
    edges = bin_edges(rows, bins)
    coded = map_rows(rows, ["label"], ["x"], lambda b: {"codes": binned(b["x"], edges)}, "codes array<double>")
    return BinnedRows(pack_rows(coded, {"codes": "u1"}), edges, int(top[0]) + 1)


def _grow(data: BinnedRows, depth: int, trees: int, kind: str, weigh) -> list[tuple[Tree, np.ndarray]]:
    """Grow ``trees`` trees together, a scan per level: each with zeros as values, and the sums of its leaves.

    ``weigh(batch)`` gives for each tree its channels, one vector each (or, for classes, the weight alone).
    """
    grown = [Tree(np.full((1 << depth) - 1, -1), np.zeros((1 << depth) - 1, "int64"), np.zeros((1 << depth, 1))) for _ in range(trees)]
    sides: list[np.ndarray] = []
    bins, classes, p = data.bins, data.classes, len(data.edges)
    for level in range(depth):
        nodes = 1 << level
        width = max(1, CHUNK // ((classes if kind == "classes" else 3) * nodes * bins))  # features whose sums fit into one buffer

        def statistic(batch, level=level, nodes=nodes, width=width, grown=tuple(grown)):
            out = {}
            for t, (tree, channels) in enumerate(zip(grown, weigh(batch))):
                node = tree.nodes(batch["codes"], level)
                for first in range(0, p, width):
                    codes = batch["codes"][:, first : first + width]
                    if kind == "classes":
                        out[f"{t}|{first}"] = histogram(codes, batch["label"] * nodes + node, classes * nodes, bins, channels)
                    else:
                        out[f"{t}|{first}"] = np.stack([histogram(codes, node, nodes, bins, c) for c in channels])
            return out

        def split(key, flat, nodes=nodes, width=width):
            first = int(key.split("|")[1])
            sums = np.moveaxis(flat.reshape(-1, nodes, min(width, p - first), bins), 0, -1)
            feature, cut, side, _, share = _compared(sums, kind)
            return np.column_stack([share, np.where(feature >= 0, first + feature, -1), cut, side.reshape(nodes, -1)])

        found = data.packed.reduce(statistic, split)
        sides = []
        for t, tree in enumerate(grown):
            each = np.stack([found[f"{t}|{first}"].reshape(nodes, -1) for first in range(0, p, width)])
            best = each[each[:, :, 0].argmax(0), np.arange(nodes)]  # of equal ones the first features'
            place = slice(nodes - 1, 2 * nodes - 1)
            tree.features[place], tree.cuts[place] = best[:, 1].astype("int64"), best[:, 2].astype("int64")
            sides.append(best[:, 3:].reshape(2 * nodes, -1))
    return list(zip(grown, sides))


def fit_class_tree(data: BinnedRows, depth: int = TREE_DEPTH, weigh=None) -> tuple[Tree, np.ndarray]:
    """A classification tree whose values are the class shares of its leaves, and the leaves' weights per class."""
    ones = weigh or (lambda batch: [np.ones(len(batch["label"]))])
    ((tree, leaves),) = _grow(data, depth, 1, "classes", ones)
    total = leaves.sum(1, keepdims=True)
    shares = np.divide(leaves, total, out=np.zeros_like(leaves), where=total > 0)
    return replace(tree, values=shares), leaves


@dataclass(frozen=True)
class TreeModel:
    """One tree or boosted trees.  The class with the largest score wins, the smallest class on a tie.

    Scores begin with ``start``'s values (if any), and round r adds those of ``trees[r]``: one tree with a
    number per class, or one tree per class with one number.
    """

    edges: list[np.ndarray]
    classes: int
    trees: tuple[tuple[Tree, ...], ...]
    start: Tree | None = None
    learners: tuple[tuple[int, float, float], ...] = ()  # round, error and weight, where trees vote

    def _round(self, codes: np.ndarray, trees: tuple[Tree, ...]) -> np.ndarray:
        return np.column_stack([t.outputs(codes) for t in trees])

    def stages(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        """Scores of all classes after each round."""
        start = self.start.outputs(codes) if self.start is not None else np.zeros((len(codes), self.classes))
        return accumulate((self._round(codes, t) for t in self.trees), np.add, initial=start)

    def predict(self, df: DataFrame, features: Sequence[str] | str, keep: Sequence[str]) -> DataFrame:
        """The columns ``keep`` of complete rows, with ``prediction`` and the ``scores`` of all classes."""
        rows = df.where(is_complete(features)).select(*keep, feature_array(features).alias("_x"))

        def scored(batch):
            for scores in self.stages(binned(batch["_x"], self.edges)):
                pass
            return {"prediction": scores.argmax(1), "scores": scores}

        return map_rows(rows, keep, ["_x"], scored, "prediction int, scores array<double>")

    def staged_errors(self, df: DataFrame, features: Sequence[str] | str, label: str) -> DataFrame:
        """Share of wrong predictions after each round, all rounds in one scan: (round, error)."""

        def statistic(batch):
            stages = self.stages(binned(batch["x"], self.edges))
            wrong = [float((scores.argmax(1) != batch["label"]).sum()) for scores in stages]
            return {"all": [len(batch["label"]), *wrong[1:]]}

        rows = labelled_rows(df, features, label)
        found = collect_sums(sum_over_rows(rows, statistic)).get("all", np.zeros(1))
        errors = [(r, float(w / found[0])) for r, w in enumerate(found[1:], 1)]
        return df.sparkSession.createDataFrame(errors, "round int, error double")

    def learner_table(self, spark) -> DataFrame:
        return spark.createDataFrame(list(self.learners), "round int, error double, weight double")

    def splits(self, spark) -> DataFrame:
        """The splits of all trees: round, tree, node (level by level from 0), feature (from 0), threshold (that and less go left)."""
        rows = [
            (r, t, n, int(f), float(self.edges[f][c]))
            for r, trees in enumerate(self.trees, 1) for t, tree in enumerate(trees)
            for n, (f, c) in enumerate(zip(tree.features, tree.cuts)) if f >= 0
        ]
        return spark.createDataFrame(rows, "round int, tree int, node int, feature int, threshold double")


def fit_tree(df: DataFrame, features: Sequence[str] | str, label: str, depth: int = TREE_DEPTH, bins: int = BINS) -> TreeModel:
    """A classification tree with at most ``2 ** depth`` leaves, split by purity."""
    data = bin_rows(labelled_rows(df, features, label), bins)
    tree, _ = fit_class_tree(data, depth)
    data.unpersist()
    return TreeModel(data.edges, data.classes, ((tree,),))


def fit_adaboost(
    df: DataFrame, features: Sequence[str] | str, label: str, rounds: int = 300, depth: int = TREE_DEPTH, bins: int = BINS,
) -> TreeModel:
    """Multiclass stagewise additive boosting of small trees (Zhu et al., 2009).

    Stops early at a perfect tree or at one no better than chance.
    """
    data = bin_rows(labelled_rows(df, features, label), bins)
    classes = data.classes
    trees: list[tuple[Tree, float]] = []  # with values 1 for the class that a leaf votes for; weights
    learners, kept, shift, total = [], 0, 0.0, None

    def missed(codes, label, some):
        """Sum of the weights of the trees that are wrong."""
        out = np.zeros(len(codes))
        for tree, weight in some:
            out += weight * (1.0 - tree.outputs(codes)[np.arange(len(codes)), label])
        return out

    for number in range(1, rounds + 1):
        pending, fresh = tuple(trees[kept:]), kept == 0

        def weigh(batch, pending=pending, fresh=fresh, shift=shift):
            log = missed(batch["codes"], batch["label"], pending)
            return [np.exp((log if fresh else log + batch["state"]) - shift)]

        tree, leaves = fit_class_tree(data, depth, weigh)
        total = leaves.sum()
        wins = leaves.argmax(1)
        error = float(1.0 - leaves[np.arange(len(leaves)), wins].sum() / total)
        if error >= 1.0 - 1.0 / classes:
            break
        weight = float(np.log((1.0 - error) / error) + np.log(classes - 1.0)) if error > TINY**2 else 1.0
        trees.append((replace(tree, values=np.eye(classes)[wins]), weight))
        learners.append((number, max(error, 0.0), weight))
        if error <= TINY**2:
            break
        shift += float(np.log1p(error * np.expm1(weight)))  # keeps the sum of the weights as it was
        if number % REFRESH == 0:
            data.refresh(lambda codes, label, some=tuple(trees): missed(codes, label, some))
            kept = len(trees)
    data.unpersist()
    rounds_ = tuple((replace(tree, values=weight * tree.values),) for tree, weight in trees)
    return TreeModel(data.edges, classes, rounds_, learners=tuple(learners))


def fit_gradient_boost(
    df: DataFrame, features: Sequence[str] | str, label: str, rounds: int = 300, rate: float = 0.1, depth: int = TREE_DEPTH,
    bins: int = BINS,
) -> TreeModel:
    """Multiclass gradient boosting on softmax residuals (Friedman, 2001), started from one tree.

    A round grows one regression tree per class, all in the same scans; leaves take the Newton value of their rows.
    """
    data = bin_rows(labelled_rows(df, features, label), bins)
    classes = data.classes
    start, _ = fit_class_tree(data, depth)
    start = replace(start, values=np.log(np.clip(start.values, TINY, 1.0 - TINY)))
    trees: list[tuple[Tree, ...]] = []
    kept = 0

    def summed(codes, some):
        out = np.zeros((len(codes), classes))
        for per_class in some:
            out += np.column_stack([t.outputs(codes) for t in per_class])
        return out

    for number in range(1, rounds + 1):
        pending, fresh = tuple(trees[kept:]), kept == 0

        def weigh(batch, pending=pending, fresh=fresh):
            codes = batch["codes"]
            scores = summed(codes, pending) + (start.outputs(codes) if fresh else batch["state"].reshape(len(codes), classes))
            shares = np.exp(scores - scores.max(1, keepdims=True))
            shares /= shares.sum(1, keepdims=True)
            residual = np.eye(classes)[batch["label"]] - shares
            slope = np.abs(residual) * (1.0 - np.abs(residual))
            return [(np.ones(len(codes)), residual[:, c], slope[:, c]) for c in range(classes)]

        found = []
        for tree, leaves in _grow(data, depth, classes, "squares", weigh):
            up, down = leaves[:, 1], leaves[:, 2]
            step = np.divide(up, down, out=np.zeros_like(up), where=down > 1e-12)
            found.append(replace(tree, values=(rate * (classes - 1) / classes * step)[:, None]))
        trees.append(tuple(found))
        if number % REFRESH == 0 and number < rounds:
            data.refresh(lambda codes, label, some=tuple(trees): start.outputs(codes) + summed(codes, some))
            kept = len(trees)
    data.unpersist()
    return TreeModel(data.edges, classes, tuple(trees), start)
