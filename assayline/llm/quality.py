"""Document quality without labels: overlapping heuristic labellers, and a hashed linear scorer trained on what they agree on.

Method: every labeller votes good, bad or abstains on every document.  The vectors of votes are counted in Spark over all
documents; expectation-maximisation on these counts estimates how often each labeller votes how on good and on
bad documents, and gives every vector its posterior.  Posteriors of a bounded sample of documents train a
linear scorer on hashed features of words; the scorer then rates all documents.

Cases: null, empty and wordless texts get bad votes for their length and are scored like any other.  Very long texts are
read whole.  If all documents vote alike the posterior is the prior.  Repeated rows count once each and score
alike.  Other columns are not read.
"""

from __future__ import annotations

import re
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.llm.common import as_bytes, map_batches, only

BUCKETS = 1 << 15
#: Bounds of the sample that the scorer is trained on: documents, and code points of one of them.
SAMPLE_ROWS, SAMPLE_LENGTH = 6000, 8000
KEEP = 0.5
#: Labellers are made to call good documents bad at most this often; without the bound, a kind of bad documents that
#: shares no labeller with the others would be explained as good ones.
MOST_WRONGLY_BAD = 0.01
CACHE_WORDS = 200_000
#: Bytes of a word whose shape is remembered.
MOST_REMEMBERED = 256

# Frequent words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in is it that was for on are with as be at by this from or an have not "
    "der die und das von zu den mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les des et en un une du que qui dans est pour par sur au pas plus de "
    "el los las y del se por con para su al lo no".split()
)
_FUNCTION_WORDS = frozenset(w.encode() for w in FUNCTION_WORDS)
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(0xC0, 0x100))  # first bytes of other characters count as letters
_SYMBOLS = b"!#$%&*+/<=>@[\\]^_`{|}~"
_MARKS = b"#$%&*@^~"
#: Letters and digits (and all that is not ASCII) as a, marks as m, other signs as they are.
_ROUGH = bytes(97 if b >= 128 or chr(b).isalnum() else 109 if b in _MARKS else 32 if chr(b).isspace() else b for b in range(256))
_PLAIN = bytes(32 if b in b".,;:!?\"'()" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORDLESS = re.compile(rb" [^a ]+(?= )")


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def _vote(value: float, good_below: float, bad_above: float) -> int:
    return 0 if value > bad_above else 1 if value < good_below else -1


def votes(text: bytes) -> list[int]:
    """Votes of the labellers on a UTF-8 text: 1 good, 0 bad, -1 abstains."""
    words = text.split()
    n, letters = len(words), _count(text, _LETTERS)
    if n < 3 or not letters:
        return [-1, -1, -1, -1, -1, -1, -1, 0]
    rough = (b" " + b" ".join(words) + b" ").translate(_ROUGH)
    plain = text.translate(_PLAIN).split()
    return [
        _vote(_count(text, _UPPER) / letters, 0.2, 0.5),
        _vote(_count(text, _SYMBOLS) / letters, 0.04, 0.1),
        _vote(sum(map(eq, words, words[1:])) / n, 0.05, 0.2),
        _vote(1 - len(set(plain)) / max(1, len(plain)), 0.85, 0.95),
        _vote(len(_WORDLESS.findall(rough)) / n, 0.03, 0.15),
        _vote(rough.count(b"m ") / n, 0.03, 0.2),
        _vote(-sum(map(_FUNCTION_WORDS.__contains__, plain)) / n, -0.1, -0.02) if n >= 20 else -1,
        _vote(-n, -20, -3),
    ]


class LabelModel:
    """How often each labeller votes how, given the class; and how common the classes are."""

    def __init__(self, prior: float, given: np.ndarray) -> None:
        self.prior, self.given = prior, given  # given[class, labeller, vote], among its votes; abstaining says nothing

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of being good, per vector of votes."""
        at = np.arange(patterns.shape[1])
        each = np.where(patterns >= 0, np.log(self.given)[:, at, np.maximum(patterns, 0)], 0)
        logs = each.sum(2) + np.log([[1 - self.prior], [self.prior]])
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))

    def accuracies(self) -> np.ndarray:
        """Per labeller, how often it is right when it votes."""
        return self.given[0, :, 0] * (1 - self.prior) + self.given[1, :, 1] * self.prior


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation, starting with every document bad that a labeller calls bad.

    Kinds of bad documents hardly overlap, so that most labellers call most of them good; a start from the majority
    would take one kind for the whole class.
    """
    good = np.where((patterns == 0).any(1), 0.05, 0.95)
    for _ in range(rounds):
        weights = np.stack([(1 - good) * counts, good * counts])
        given = np.stack([np.stack([(weights * (patterns[:, i] == v)).sum(1) for v in (0, 1)], 1) for i in range(patterns.shape[1])], 1)
        given = (given + 0.5) / (given + 0.5).sum(2, keepdims=True)
        given[1, :, 0] = np.minimum(given[1, :, 0], MOST_WRONGLY_BAD)
        given[1, :, 1] = 1 - given[1, :, 0]
        model = LabelModel(float(np.clip(weights[1].sum() / max(1e-12, counts.sum()), 0.01, 0.99)), given)
        before, good = good, model.posterior(patterns)
        if np.abs(good - before).max() < 1e-6:
            break
    return model


#: Upper and lower case, digits and signs of a word; all that is not ASCII counts as lower case.
_KINDS = bytes(
    97 if b >= 128 or chr(b).islower() else 65 if chr(b).isupper() else 48 if chr(b).isdigit() else b for b in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


class _Filled(dict):
    """A function's values, computed once unless the key is long; emptied when it holds CACHE_WORDS of them."""

    def __init__(self, function) -> None:
        super().__init__()
        self.function = function

    def __missing__(self, key):
        value = self.function(key)
        if len(key) <= MOST_REMEMBERED:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[key] = value
        return value


def _shape(kinds: bytes) -> bytes:
    """Kinds of all characters of a word with runs shortened to two; a digest of them if they are still many."""
    shape = _RUN.sub(rb"\1\1", kinds)
    return shape if len(shape) <= 64 else xxhash.xxh3_128_digest(shape)


_SHAPES = _Filled(_shape)


def _bucket(feature: bytes) -> int:
    return xxhash.xxh32_intdigest(feature) % BUCKETS


_SINGLE = _Filled(lambda shape: _bucket(shape))
_PAIR = _Filled(lambda pair: _bucket(pair[0] + b" " + pair[1]))
_AGAIN, _EMPTY = _bucket(b"again again"), _bucket(b"empty empty empty")


def features(text: bytes) -> tuple[list[int], float]:
    """Buckets of a UTF-8 text's hashed features, and what each counts: shapes of words, of pairs of words, repeats."""
    words = text.split()
    if not words:
        return [_EMPTY], 1.0
    shapes = [_SHAPES[k] for k in b" ".join(words).translate(_KINDS).split(b" ")]
    found = [_SINGLE[x] for x in shapes]
    found += [_PAIR[x] for x in zip(shapes, shapes[1:])]
    found += [_AGAIN] * sum(map(eq, words, words[1:]))
    return found, 1 / len(words)


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    def score(self, text: bytes) -> float:
        """Probability of being good."""
        found, share = features(text)
        return float(1 / (1 + np.exp(-np.clip(self.weights[found].sum() * share + self.bias, -50, 50))))


def fit(texts: list[bytes], targets: np.ndarray, epochs: int = 300, rate: float = 0.1) -> Scorer:
    """Logistic regression on hashed features against probabilities, with Adam and both classes weighing alike."""
    weights, bias = np.zeros(BUCKETS), np.zeros(1)
    if not len(texts):
        return Scorer(weights, 0.0)
    rows = [features(t) for t in texts]
    flat = np.concatenate([np.array(f) for f, _ in rows])
    owner = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    cell, inverse = np.unique(owner * BUCKETS + flat, return_inverse=True)
    value = np.bincount(inverse) * np.array([s for _, s in rows])[cell // BUCKETS]
    owner, flat = cell // BUCKETS, cell % BUCKETS
    weight = np.where(targets >= 0.5, 0.5 / max(1, (targets >= 0.5).sum()), 0.5 / max(1, (targets < 0.5).sum()))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, bias)]
    for epoch in range(epochs):
        logit = np.bincount(owner, weights[flat] * value, len(rows)) + bias[0]
        slope = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - targets) * weight
        gradients = (np.bincount(flat, slope[owner] * value, BUCKETS) + 1e-5 * weights, np.array([slope.sum()]))
        for p, g, (m, v) in zip((weights, bias), gradients, state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.99 ** (epoch + 1))) + 1e-8)
    return Scorer(weights, float(bias[0]))


def voted(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """Columns ``keep`` and the ``votes`` of the labellers, a letter each: g, b or - ."""

    def make():
        def step(batch: pa.RecordBatch):
            letters = ["".join("-bg"[v + 1] for v in votes(x)) for x in as_bytes(batch.column(len(keep)))]
            return [*batch.columns[: len(keep)], letters]

        return step

    fields = [*only(docs, *keep).schema.fields, T.StructField("votes", T.StringType())]
    return map_batches(only(docs, *keep, text), T.StructType(fields), make)


def train(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[Scorer, LabelModel | None]:
    """The scorer, and the model of the labellers it was trained with (none if there are no documents)."""
    counted = voted(docs, text, ()).groupBy("votes").count().toPandas()  # at most 3 ** 8 rows
    if not len(counted):
        return fit([], np.zeros(0)), None
    patterns = np.array([["-bg".index(c) - 1 for c in v] for v in counted["votes"]])
    model = estimate(patterns, counted["count"].to_numpy(float))
    share = min(1.0, 1.2 * SAMPLE_ROWS / counted["count"].sum())
    part = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    sample = docs.where(part < share).where(F.length(t) <= SAMPLE_LENGTH).select(t.alias("text")).toPandas()
    texts = sorted((x.encode() for x in sample["text"]), key=lambda x: xxhash.xxh64_intdigest(x))[:SAMPLE_ROWS]
    return fit(texts, model.posterior(np.array([votes(x) for x in texts]).reshape(-1, patterns.shape[1]))), model


def scored(docs: DataFrame, scorer: Scorer, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``score``: probability of being good."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def make():
        scorer = shared.value

        def step(batch: pa.RecordBatch):
            return [*batch.columns[: len(keep)], [scorer.score(x) for x in as_bytes(batch.column(len(keep)))]]

        return step

    fields = [*only(docs, *keep).schema.fields, T.StructField("score", T.DoubleType())]
    return map_batches(only(docs, *keep, text), T.StructType(fields), make)
