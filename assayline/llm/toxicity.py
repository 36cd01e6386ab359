"""Toxic texts by subword-bag embeddings.

Method: a word is the bag of its character n-grams (3 to 5, with marks at its ends) and itself, hashed to
buckets; its vector is the mean of the buckets' embeddings.  Word vectors are averaged over a window of words and
go into a linear softmax; embeddings and softmax are trained jointly in numpy.  A text scores as its most toxic
window, so a few words in a long text count as much as in a short one, and misspellings that were never
seen share the vectors of their n-grams.

Because the mean and the softmax are linear, a trained model comes down to one number per bucket; scoring a text is
exactly the forward pass, computed from these.

Cases: null, empty or wordless texts score as a window without evidence.  Texts shorter than a window are one window.  Very
long texts are read whole; a run without spaces, as in Chinese, Japanese or Thai, is read in overlapping pieces.  Labels that are null are not used; without labels of both classes the
model stays at its start and every text scores alike.  Repeated labels count once per row.  Repeated rows score alike.  Empty tables
give empty results, and documents that pass keep all their columns, whatever their names.
"""

from __future__ import annotations

from array import array
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.llm.common import as_text, kept, map_batches, only

BUCKETS, DIMENSION = 1 << 17, 8
WINDOW = 4
#: Texts of the sample that a bucket must occur in to be learnt; rarer ones only tell single texts apart.
LEAST_TEXTS = 3
#: Bounds of the training sample: labelled rows per class, and code points of a text in it.
SAMPLE_ROWS, SAMPLE_LENGTH = 2500, 6000
REJECT = 0.7
#: Training texts are told apart better than others, so calibration may not be steeper than this.
STEEPEST = 8.0
#: Runs without spaces of over LONGEST characters are cut into pieces that overlap by OVERLAP, so that no n-gram is lost; a
#: window of pieces is about as long as one of words.
LONGEST, PIECE, OVERLAP = 32, 6, 4
#: Words whose evidence a worker remembers, twice.
CACHE_WORDS = 300_000

#: Punctuation parts words; all digits are one.
_LETTERS = str.maketrans(
    dict.fromkeys(".,;:!?\"'()[]{}<>|/\\_-+=~`#%^&…«»“”‘’¿¡–—、。，！？；：「」『』（）《》【】・", " ") | dict.fromkeys("123456789", "0")
)


def _pieces(run: str) -> list[str]:
    """A run without spaces as words of at most PIECE characters that hold all of its n-grams."""
    step = PIECE - OVERLAP
    return [run[i : i + PIECE] for i in range(0, max(1, len(run) - OVERLAP), step)]


def words_of(text: str) -> list[str]:
    """Words in lower case, long runs in pieces; a word that is repeated at once counts once."""
    words = text.lower().translate(_LETTERS).split()
    if max(map(len, words), default=0) > LONGEST:
        words = [piece for word in words for piece in (_pieces(word) if len(word) > LONGEST else (word,))]
    return [word for word, _ in groupby(words)]


def buckets_of(word: str) -> list[int]:
    """Buckets of the word and of its character n-grams."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
    return [xxhash.xxh32_intdigest(gram) % BUCKETS for gram in (*grams, word)]


class Model:
    """Embeddings of the buckets and a linear softmax over two classes, of which only the difference matters."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.02, (BUCKETS, DIMENSION)).astype("float32")
        self.output = rng.normal(0, 1, DIMENSION).astype("float32")
        self.bias = -1.0

    def evidence(self) -> np.ndarray:
        """Per bucket, its share of the difference of the two classes' logits."""
        return self.embedding @ self.output

    def fit(self, texts: list[list[str]], labels: np.ndarray, epochs: int = 30, rate: float = 0.02) -> Model:
        """Joint training with Adam on the log-loss of each text's strongest window.

        The embeddings start along the softmax at the log-odds of their bucket's presence in the two classes.
        """
        if len(set(labels.tolist())) < 2:
            return self
        texts = [t or [""] for t in texts]
        index: dict[str, int] = {}
        words = np.fromiter((index.setdefault(w, len(index)) for w in chain.from_iterable(texts)), "int32")
        lengths = np.array([len(t) for t in texts])
        buckets, counted = array("i"), array("i")  # flat, as lists of a few million numbers would fill the driver
        for word in index:
            bag = buckets_of(word)
            buckets.extend(bag)
            counted.append(len(bag))
        n_words = len(index)
        del index
        flat, sizes = np.frombuffer(buckets, "int32"), np.frombuffer(counted, "int32")
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(n_words, dtype="int32"), sizes)
        first = np.cumsum(lengths) - lengths
        # Window i covers words i to i + WINDOW of the text that i lies in, or fewer at its end.
        position = np.arange(len(words)) - np.repeat(first, lengths)
        width = np.minimum(WINDOW, np.repeat(lengths, lengths))
        inside = position + width <= np.repeat(lengths, lengths)
        weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
        cuts = np.append(starts, len(flat))
        present = np.zeros((2, BUCKETS))
        for begin, n, label in zip(first, lengths, labels):
            parts = [flat[cuts[w] : cuts[w + 1]] for w in set(words[begin : begin + n].tolist())]
            present[label][np.unique(np.concatenate(parts))] += 1
        n_texts = np.array([(labels == c).sum() for c in (0, 1)])[:, None]
        odds = np.log((present + 0.5) / (n_texts + 1))
        learnt = present.sum(0) >= LEAST_TEXTS
        start = np.where(learnt, odds[1] - odds[0], 0)[:, None] * self.output / (self.output @ self.output)
        self.embedding = np.where(learnt[:, None], self.embedding + start, 0).astype("float32")
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.embedding, self.output, np.zeros(1, "float32"))]
        bias = np.array([self.bias], "float32")
        for epoch in range(epochs):
            per_word = np.add.reduceat(self.evidence()[flat], starts) / sizes
            sums = np.append(0.0, np.cumsum(per_word[words]))
            ends = np.minimum(np.arange(len(words)) + width, len(words))
            strength = np.where(inside, (sums[ends] - sums[:-1]) / width, -np.inf)
            logit = np.maximum.reduceat(strength, first)
            hit = np.flatnonzero(strength == np.repeat(logit, lengths))
            at = hit[np.searchsorted(hit, first)]
            span = width[at]
            slope = (1 / (1 + np.exp(-(logit + bias[0]))) - labels) * weight
            per_position = np.zeros(len(words) + 1)
            np.add.at(per_position, at, slope / span)
            np.add.at(per_position, at + span, -slope / span)
            on_word = np.bincount(words, np.cumsum(per_position[:-1]), n_words) / sizes
            on_bucket = np.where(learnt, np.bincount(flat, on_word.astype("float32")[owner], BUCKETS), 0).astype("float32")
            gradients = (np.outer(on_bucket, self.output), on_bucket @ self.embedding, np.array([slope.sum()], "float32"))
            for p, g, (m, v) in zip((self.embedding, self.output, bias), gradients, moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                step = rate * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.99 ** (epoch + 1))) + 1e-8)
                p -= step.astype("float32")
        slope, shift = _calibrated(logit + bias[0], labels, weight)
        self.embedding *= slope
        self.bias = float(bias[0]) * slope + shift
        return self


def _calibrated(logit: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (1 to STEEPEST) and shift of a logistic curve over the trained logits, by gradient descent."""
    slope, shift = 1.0, 0.0
    for _ in range(2000):
        error = (1 / (1 + np.exp(-(slope * logit + shift))) - labels) * weight
        slope = min(STEEPEST, max(1.0, slope - 2.0 * float(error @ logit)))
        shift -= 2.0 * float(error.sum())
    return slope, shift


class Scorer:
    """Evidence per bucket and bias of a trained model."""

    def __init__(self, evidence: np.ndarray, bias: float) -> None:
        self.evidence, self.bias = evidence.tolist(), bias
        self.known: dict[str, float] = {}
        self.older: dict[str, float] = {}

    def word(self, word: str) -> float:
        value = self.older.get(word)
        if value is None:
            bag = buckets_of(word)
            evidence = self.evidence
            value = sum([evidence[b] for b in bag]) / len(bag)
        if len(self.known) >= CACHE_WORDS:
            self.older, self.known = self.known, {}
        self.known[word] = value
        return value

    def score(self, text: str) -> float:
        """Probability of being toxic, of the text's strongest window."""
        words = words_of(text)
        if not words:
            return float(1 / (1 + np.exp(-self.bias)))
        known = self.known
        values = np.array([known[w] if w in known else self.word(w) for w in words])
        width = min(WINDOW, len(values))
        sums = np.append(0.0, np.cumsum(values))
        return float(1 / (1 + np.exp(-((sums[width:] - sums[:-width]).max() / width + self.bias))))


def training_sample(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str) -> tuple[list[str], np.ndarray]:
    """Texts and labels, at most SAMPLE_ROWS per class in the order of a hash of the key, none over SAMPLE_LENGTH."""
    k = F.col(f"`{key}`")
    usable = only(labels, key, label).where(k.isNotNull() & F.col(f"`{label}`").isin(0, 1)).distinct()
    usable = usable.select(k.alias("key"), F.col(f"`{label}`").cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # Half as many again as needed, as some are too long; hashes are even, so this stays near its bound.
    share = {c: min(1.0, 1.5 * SAMPLE_ROWS / max(1, sizes.get(c, 0))) for c in (0, 1)}
    part = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    some = usable.where(part < F.when(F.col("label") == 1, share[1]).otherwise(share[0]))
    texts = only(docs, key, text).select(k.alias("key"), F.col(f"`{text}`").alias("text"))
    rows = (
        texts.where(F.length("text").between(1, SAMPLE_LENGTH))
        .join(F.broadcast(some), "key")  # about 3 * SAMPLE_ROWS rows, whatever the corpus
        .select("text", "label", F.xxhash64("key", "text").alias("order"))
        .toPandas()
        .sort_values(["order", "label"])
        .groupby("label")
        .head(SAMPLE_ROWS)
    )
    return rows["text"].tolist(), rows["label"].to_numpy("int64")


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Scorer:
    texts, classes = training_sample(docs, labels, text, key, label)
    model = Model().fit([words_of(t) for t in texts], classes)
    return Scorer(model.evidence(), model.bias)


def _scorer(packed: bytes, bias: float) -> Scorer:
    return Scorer(np.frombuffer(packed, "float32"), bias)


def scored(
    docs: DataFrame, scorer: Scorer, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score"
) -> DataFrame:
    """Columns ``keep`` and the score."""
    shared = docs.sparkSession.sparkContext.broadcast((np.array(scorer.evidence, "float32").tobytes(), scorer.bias))

    def make():
        scorer = kept(_scorer, *shared.value)

        def step(batch: pa.RecordBatch):
            return [*batch.columns[: len(keep)], [scorer.score(x) for x in as_text(batch.column(len(keep)))]]

        return step

    fields = [*only(docs, *keep).schema.fields, T.StructField(name, T.DoubleType())]
    return map_batches(only(docs, *keep, text), T.StructType(fields), make)


def accepted(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """The documents, all columns, that score below REJECT."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return scored(docs, scorer, text, tuple(docs.columns), name).where(F.col(f"`{name}`") < REJECT).drop(name)


def held_out(key: str = "doc_id"):
    """Whether a row's label may not be learnt from; rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))
