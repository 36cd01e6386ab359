"""All-relevant feature screening against shuffled copies (Kursa and Rudnicki, 2010)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import comb, factorial, gcd
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.operators.trees import MAX_CLASSES, Tree, best_splits, bin_edges, binned
from assayline.plans.scans import Batch, PackedRows, feature_array, feature_names, is_complete, map_rows, pack_rows

#: Bins per feature; bytes of histograms that a scan may hold in each task.
BINS, SCAN_BYTES = 32, 64 << 20
_POISSON = np.cumsum([np.exp(-1.0) / factorial(k) for k in range(12)])


def binomial_tail(hits: int, rounds: int) -> float:
    """Probability of at least ``hits`` in ``rounds`` fair coin throws."""
    return sum(comb(rounds, k) for k in range(hits, rounds + 1)) / 2.0**rounds


def affine(n: int, seed: int, round_number: int) -> np.ndarray:
    """A permutation p -> (a p + b) mod n of the places of ``n`` rows, another one in each round."""
    rng = np.random.default_rng([seed, round_number, n])
    a = int(rng.integers(1, n + 1)) if n > 2 else 1
    while gcd(a, n) > 1:
        a += 1
    return (a * np.arange(n) + int(rng.integers(1, max(n, 2)))) % n


@dataclass(frozen=True)
class Shadows:
    """How a round pairs the rows of a block, and what classes weigh."""

    weights: np.ndarray  # of the classes
    seed: int

    def codes(self, batch: Batch, round_number: int, kept: Sequence[int]) -> np.ndarray:
        """Bins of the features ``kept`` and of their shadows."""
        own = batch["codes"][:, list(kept)]
        return np.concatenate([own, own[affine(len(own), self.seed, round_number)]], 1)

    def rows(self, batch: Batch) -> np.ndarray:
        return np.arange(len(batch["label"]) if len(batch["label"]) > 1 else 0)  # a single row cannot be shuffled


@dataclass(frozen=True)
class ShadowedRows:
    """Binned rows in one random order, packed.

    The order is drawn once, by a hash of the id, and cut into blocks.  In each round the row at place (a p + b) mod n of
    a block of n rows lends its features, all together, to the row at place p as shadows, so every shadow keeps
    its distribution and the shadows their correlations, while the link to the label is broken.  No round needs a shuffle.
    """

    packed: PackedRows
    classes: int
    shadows: Shadows


class Learner(Protocol):
    """Turns shared statistics of the rows into importances."""

    def importances(self, rows: ShadowedRows, rounds: Sequence[int], kept: Sequence[int]) -> np.ndarray:
        """(round, feature) for the features ``kept`` and then their shadows, all of ``rounds`` in the same scans."""

    def at_once(self, rows: ShadowedRows, kept: Sequence[int]) -> int:
        """How many rounds may share scans."""


@dataclass(frozen=True)
class ForestLearner:
    """Mean share of the purity gained in bootstrapped trees that look at a few random features in each node."""

    trees: int = 100
    depth: int = 5

    def at_once(self, rows: ShadowedRows, kept: Sequence[int]) -> int:
        tried = max(1, int(np.sqrt(2 * len(kept))))
        return max(1, SCAN_BYTES // (self.trees * rows.classes * (1 << (self.depth - 1)) * tried * BINS * 8))

    def importances(self, rows: ShadowedRows, rounds: Sequence[int], kept: Sequence[int]) -> np.ndarray:
        width, classes, shadows = 2 * len(kept), rows.classes, rows.shadows
        tried = max(1, int(np.sqrt(width)))
        depth, trees, seed = self.depth, self.trees, rows.shadows.seed
        inner = (1 << depth) - 1
        grown = {(r, t): Tree(np.full(inner, -1), np.zeros(inner, "int64"), np.zeros((1 << depth, 1))) for r in rounds for t in range(self.trees)}
        gains = np.zeros((len(rounds), self.trees, width))

        def looked_at(r: int, t: int, level: int) -> np.ndarray:
            rng = np.random.default_rng([seed, r, t, level])
            return np.argsort(rng.random((1 << level, width)), 1)[:, :tried]

        for level in range(depth):
            nodes = 1 << level

            def statistic(batch, level=level, nodes=nodes):
                label, every = batch["label"], shadows.rows(batch)
                hashes = batch["hash"].view("u8")
                out = {}
                for r in rounds:
                    codes = shadows.codes(batch, r, kept)
                    for t in range(trees):
                        drawn = np.searchsorted(_POISSON, _uniform(hashes, (seed * 7919 + r) * 1009 + t))
                        use = every[drawn[every] > 0]
                        node = grown[r, t].nodes(codes[use], level)
                        seen = codes[use[:, None], looked_at(r, t, level)[node]]
                        place = (((label[use] * nodes + node)[:, None]) * tried + np.arange(tried)) * BINS + seen
                        out[f"{r}|{t}"] = np.bincount(place.ravel(), np.repeat(drawn[use], tried), minlength=classes * nodes * tried * BINS)
                return out

            def split(key, counts, nodes=nodes):
                sums = np.moveaxis(counts.reshape(classes, nodes, tried, BINS), 0, -1) * shadows.weights
                feature, cut, _, gain = best_splits(sums, "classes")
                return np.stack([feature, cut, gain])

            for key, found in rows.packed.reduce(statistic, split).items():
                r, t = map(int, key.split("|"))
                feature, cut, gain = found.reshape(3, nodes)
                feature, cut = feature.astype("int64"), cut.astype("int64")
                real = looked_at(r, t, level)[np.arange(nodes), np.maximum(feature, 0)]
                tree, place = grown[r, t], slice(nodes - 1, 2 * nodes - 1)
                tree.features[place], tree.cuts[place] = np.where(feature >= 0, real, -1), cut
                np.add.at(gains[list(rounds).index(r), t], real, gain)
        total = gains.sum(2, keepdims=True)
        return np.divide(gains, total, out=np.zeros_like(gains), where=total > 0).mean(1)


@dataclass(frozen=True)
class StumpLearner:
    """Purity gained by the best single cut of each feature, on all rows."""

    def at_once(self, rows: ShadowedRows, kept: Sequence[int]) -> int:
        return max(1, SCAN_BYTES // (rows.classes * 2 * len(kept) * BINS * 8))

    def importances(self, rows: ShadowedRows, rounds: Sequence[int], kept: Sequence[int]) -> np.ndarray:
        width, classes, shadows = 2 * len(kept), rows.classes, rows.shadows

        def statistic(batch):
            every, out = shadows.rows(batch), {}
            for r in rounds:
                place = (batch["label"][:, None] * width + np.arange(width)) * BINS + shadows.codes(batch, r, kept)
                out[str(r)] = np.bincount(place[every].ravel(), minlength=classes * width * BINS)
            return out

        def gained(key, counts):
            each = np.moveaxis(counts.reshape(classes, width, 1, BINS), 0, -1) * shadows.weights  # a feature stands where nodes do
            return best_splits(each, "classes")[3]

        found = rows.packed.reduce(statistic, gained)
        return np.array([found[str(r)] for r in rounds])


def _uniform(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit hashes and a salt."""
    mixed = hashes ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(11)) / float(1 << 53)


def shadowed_rows(df: DataFrame, id_col: str, features: Sequence[str] | str, label: str, balanced: bool = True, seed: int = 0) -> ShadowedRows:
    """Complete rows, labelled 0, 1, ..., binned and packed in an order that a hash of the id gives."""
    known = df.where(is_complete(features) & F.col(label).isNotNull())
    rows = known.select(
        feature_array(features).alias("x"), F.col(label).cast("int").alias("label"), F.xxhash64(F.lit(seed), id_col).alias("hash")
    )
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).limit(MAX_CLASSES + 1).collect()}
    if not sizes or min(sizes) < 0 or max(sizes) >= MAX_CLASSES:
        raise ValueError(f"labels must be 0 .. {MAX_CLASSES - 1}")
    classes = max(sizes) + 1
    total = sum(sizes.values())
    weights = np.array([total / (len(sizes) * sizes[c]) if balanced and c in sizes else 1.0 for c in range(classes)])
    edges = bin_edges(rows, BINS)
    spread = rows.repartition("hash").sortWithinPartitions("hash")
    coded = map_rows(spread, ["label", "hash"], ["x"], lambda b: {"codes": binned(b["x"], edges)}, "codes array<double>")
    return ShadowedRows(pack_rows(coded, {"codes": "u1"}), classes, Shadows(weights, seed))


def relevant_features(
    df: DataFrame,
    id_col: str,
    features: Sequence[str] | str,
    label: str,
    rounds: int = 100,
    learner: Learner | None = None,
    balanced: bool = True,
    alpha: float = 0.05,
    seed: int = 0,
) -> DataFrame:
    """Decision for every feature: (position, feature, hits, rounds, decision, ranking).

    In each round ``learner`` (a forest unless given) measures the importance of the features and of their
    shadows; a feature scores a hit when its importance exceeds that of the best shadow.  A
    two-sided binomial test, corrected for the number of features, accepts or
    rejects; undecided features stay ``tentative``.  Ranking is 1 for accepted, 2
    for tentative, then by hits.  Rounds that share scans also share the features that take part.
    """
    learner = learner or ForestLearner()
    names = feature_names(df, features)
    rows = shadowed_rows(df, id_col, features, label, balanced, seed)
    p = len(names)
    hits = np.zeros(p, dtype=int)
    active = np.ones(p, dtype=bool)
    decision = np.array(["tentative"] * p, dtype=object)
    done = 0
    while done < rounds and active.any():
        kept = [int(i) for i in np.flatnonzero(decision != "rejected")]
        together = range(done, min(rounds, done + learner.at_once(rows, kept)))
        for importance in learner.importances(rows, together, kept):
            done += 1
            best_shadow = importance[len(kept):].max()
            for at, i in enumerate(kept):
                hits[i] += bool(active[i] and importance[at] > best_shadow)
            for i in np.flatnonzero(active):
                if binomial_tail(int(hits[i]), done) * p < alpha / 2:
                    decision[i], active[i] = "accepted", False
                elif binomial_tail(int(done - hits[i]), done) * p < alpha / 2:
                    decision[i], active[i] = "rejected", False
            if not active.any():
                break
    rows.packed.unpersist()
    order = sorted(set(int(h) for h, d in zip(hits, decision) if d == "rejected"), reverse=True)
    ranking = [1 if d == "accepted" else 2 if d == "tentative" else 3 + order.index(int(h)) for h, d in zip(hits, decision)]
    table = [(i, n, int(hits[i]), done, str(decision[i]), int(ranking[i])) for i, n in enumerate(names)]
    return df.sparkSession.createDataFrame(
        table, "position int, feature string, hits int, rounds int, decision string, ranking int"
    )


def keep_relevant(df: DataFrame, features: Sequence[str], decisions: DataFrame) -> DataFrame:
    """Table without the features that were not accepted (one decision per feature)."""
    accepted = {r["feature"] for r in decisions.where("decision = 'accepted'").collect()}
    return df.drop(*[f for f in features if f not in accepted])
