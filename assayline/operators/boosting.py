"""Tables of labels, votes and errors around the boosted trees of :mod:`assayline.operators.trees`."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.operators.trees import MAX_CLASSES, TREE_DEPTH, TreeModel, binned, fit_adaboost, fit_gradient_boost, fit_tree
from assayline.plans.scans import feature_array, is_complete, map_rows


def as_vectors(df: DataFrame, id_col: str, features: Sequence[str] | str, label: str) -> DataFrame:
    """(id, label double, x vector) of the complete rows; labels are 0, 1, ..."""
    complete = df.where(is_complete(features) & F.col(label).isNotNull())
    vector = array_to_vector(feature_array(features))
    return complete.select(F.col(id_col), F.col(label).cast("double").alias("label"), vector.alias("x"))


def _arrays(rows: DataFrame) -> DataFrame:
    """Rows of :func:`as_vectors` with arrays for vectors."""
    return rows.withColumn("x", vector_to_array("x")) if dict(rows.dtypes)["x"] == "vector" else rows


def misclassification(df: DataFrame, label: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose prediction is wrong: (keys, error)."""
    wrong = (F.col(label) != F.col(predicted)).cast("double")
    return df.groupBy(*keys).agg(F.avg(wrong).alias("error"))


def majority_label(df: DataFrame, label: str) -> DataFrame:
    """The most frequent label, the smallest on a tie: (label, n)."""
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(1)


def majority_error(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Error on the test rows of always predicting the training majority: (error)."""
    winner = majority_label(train, label).first()[0]
    return test.agg(F.avg((F.col(label) != F.lit(winner)).cast("double")).alias("error"))


def tree_error(train: DataFrame, test: DataFrame, depth: int = TREE_DEPTH) -> DataFrame:
    """Error of one tree on the test rows: (error)."""
    return fit_tree(_arrays(train), "x", "label", depth).staged_errors(_arrays(test), "x", "label").select("error")


def staged_scores(votes: DataFrame, id_col: str) -> DataFrame:
    """Error of the weighted vote after each round: (round, error).

    ``votes`` holds (id, label, round, prediction, weight); the class with the largest
    summed weight so far wins, the smallest class on a tie.  The votes of a row (one per round) are gathered once and tallied in place.
    """
    classes = [r[0] for r in votes.select("prediction").distinct().limit(MAX_CLASSES + 1).collect()]
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    names = F.array(*[F.lit(float(c)) for c in sorted(classes)])
    gathered = votes.groupBy(id_col, "label").agg(F.sort_array(F.collect_list(F.struct("round", F.col("prediction").cast("double").alias("p"), "weight"))).alias("v"))

    def tally(state, vote):
        sums = F.transform(state["sums"], lambda s, i: s + F.when(F.get(names, i) == vote["p"], vote["weight"]).otherwise(0.0))
        return F.struct(sums.alias("sums"), F.concat(state["winners"], F.array(F.get(names, F.array_position(sums, F.array_max(sums)).cast("int") - 1))).alias("winners"))

    start = F.struct(F.transform(names, lambda c: c * 0.0).alias("sums"), F.slice(names, 1, 0).alias("winners"))
    winners = F.aggregate("v", start, tally, lambda s: s["winners"])
    each = gathered.select("label", F.explode(F.arrays_zip(F.col("v.round").alias("round"), winners.alias("winner"))).alias("e"))
    return each.groupBy("e.round").agg(F.avg((F.col("e.winner") != F.col("label")).cast("double")).alias("error"))


def votes_of(model: TreeModel, rows: DataFrame, id_col: str) -> DataFrame:
    """What each tree of a voting model says of each row: (id, label, round, prediction, weight)."""
    weights = [weight for _, _, weight in model.learners]

    def predicted(batch):
        codes = binned(batch["x"], model.edges)
        return {"p": np.column_stack([t.outputs(codes).argmax(1) for t, in model.trees]).astype(float)}

    if not weights:  # no learner better than chance: nobody votes
        none = [F.lit(0).alias("round"), F.lit(0.0).alias("prediction"), F.lit(0.0).alias("weight")]
        return rows.select(id_col, "label", *none).limit(0)
    every = map_rows(_arrays(rows), [id_col, "label"], ["x"], predicted, "p array<double>")
    cast = every.select(id_col, "label", F.posexplode("p").alias("round", "prediction"))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.col("round"))
    return cast.select(id_col, "label", (F.col("round") + 1).alias("round"), "prediction", weight.alias("weight"))


def adaboost(
    train: DataFrame, test: DataFrame, id_col: str, rounds: int = 300, depth: int = TREE_DEPTH,
) -> tuple[DataFrame, DataFrame]:
    """Multiclass stagewise additive boosting; see :func:`assayline.operators.trees.fit_adaboost` for the model itself.

    ``train`` and ``test`` come from :func:`as_vectors`.  Returns the learners (round,
    error, weight) and the test votes (id, label, round, prediction, weight).
    """
    model = fit_adaboost(_arrays(train), "x", "label", rounds, depth)
    return model.learner_table(train.sparkSession), votes_of(model, test, id_col)


def gradient_boost(
    train: DataFrame, test: DataFrame, id_col: str | None = None, rounds: int = 300, rate: float = 0.1, depth: int = TREE_DEPTH,
) -> DataFrame:
    """Staged test error of multiclass gradient boosting: (round, error); :func:`fit_gradient_boost` returns the model."""
    return fit_gradient_boost(_arrays(train), "x", "label", rounds, rate, depth).staged_errors(_arrays(test), "x", "label")
