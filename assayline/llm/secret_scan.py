"""Secrets in texts: fixed patterns, and random strings told from ordinary identifiers by character Markov models.

Method: two models of character pairs, one of random strings and one of ordinary identifiers, are trained from samples
that the corpus labels itself: the values that the patterns find are random strings, all other
runs of the same characters are ordinary.  The pairs are counted over all documents.  A run outside the spans of the
patterns is a secret when its log-likelihood ratio reaches ``LEAST_RATIO`` and exceeds ``THRESHOLD`` per character pair; it needs no
digit, and the less ordinary its pairs are, the shorter it may be.

Cases: null or empty texts have no spans.  Spans are code points, end exclusive, of the whole match.  Very long texts
are read whole.  Without any sample both models are uniform and nothing is added.  Rows are independent, so
repeated rows get the same spans; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.llm.common import as_bytes, map_batches, only

#: Natural logarithms: the ratio that a run must reach in all and per character pair.  A run of fewer characters than
#: ``MIN_LENGTH`` cannot reach the first.
LEAST_RATIO, THRESHOLD = 20.0, 0.5
MIN_LENGTH = 8
#: Share of a uniform distribution in both models, so that the ratio of a pair is bounded however many pairs were counted.
UNIFORM = 0.02

#: Kinds in the order of spans that start together; the last is the model's.
KINDS = ("assign", "access", "hex", "random")


def _either_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


# Fixed patterns of the task, on UTF-8; letters of the keywords in either case, A-Z only.
_ASSIGN = re.compile(
    (f"({_either_case('password|passwd|secret|token|api_?key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""").encode()
)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")  # the leftmost run of hex digits that is long enough is a whole run
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_RUN_CHARACTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_RUN = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
#: Bytes as symbols of the models: 0 is everything outside a run.
_SYMBOLS = bytes(_RUN_CHARACTERS.find(b) + 1 for b in range(256))
_N = len(_RUN_CHARACTERS) + 1
_MARK_HEX = bytes(120 if b in b"0123456789abcdef" else 32 for b in range(256))
_MARK_RUN = bytes(120 if b in _RUN_CHARACTERS else 32 for b in range(256))


def pattern_spans(text: bytes) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, start of the value, end of the value) in bytes, leftmost and non-overlapping per kind."""
    found = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        found += [(m.start(), 0, m.end(), *m.span(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end(), *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"x" * 24 in text.translate(_MARK_HEX):
        found += [(m.start(), 2, m.end(), *m.span()) for m in _HEX.finditer(text)]
    return sorted(found)


def pair_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character pairs inside runs: of the values of patterns, and of everything else."""
    symbols = np.frombuffer(text.translate(_SYMBOLS), np.uint8).astype("int64")
    pairs = np.append(symbols[:-1] * _N + symbols[1:], 0)
    random = np.zeros(_N * _N, "int64")
    for _, _, _, start, end in pattern_spans(text):
        random += np.bincount(pairs[start : end - 1], minlength=_N * _N)
        pairs[start : end - 1] = 0
    return random, np.bincount(pairs, minlength=_N * _N)


def train(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log-likelihood ratios of character pairs, random strings against ordinary ones; rows are the first character.

    Pairs with a sign that joins words say nothing: they depend on a text's conventions.

    Every task adds its counts up; no more than two counts per pair of characters reach the driver.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, _N * _N), "int64")
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for value in as_bytes(batch.column(0).slice(start, 256)):
                    if value:
                        total += pair_counts(value)
        pair = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(pair, pa.int32()), pa.array(total[0, pair]), pa.array(total[1, pair])], names=["pair", "random", "plain"]
        )

    counted = only(docs, text).mapInArrow(run, "pair int, random long, plain long")
    rows = counted.groupBy("pair").agg(F.sum("random").alias("random"), F.sum("plain").alias("plain")).toPandas()
    counts = np.zeros((2, _N, _N))
    at = rows["pair"].to_numpy("int64")
    counts[0].flat[at], counts[1].flat[at] = rows["random"].to_numpy(float), rows["plain"].to_numpy(float)
    inside = counts[:, 1:, 1:] + 1.0
    logs = np.log((1 - UNIFORM) * inside / inside.sum(2, keepdims=True) + UNIFORM / inside.shape[2])
    ratio = np.zeros((_N, _N))
    ratio[1:, 1:] = logs[0] - logs[1]
    joiners = [_RUN_CHARACTERS.index(c) + 1 for c in b"+/_=-"]
    ratio[joiners], ratio[:, joiners] = 0, 0
    return ratio


def score(run: bytes, ratio: np.ndarray) -> float:
    """Mean log-likelihood ratio per character pair."""
    symbols = np.frombuffer(run.translate(_SYMBOLS), np.uint8)
    return float(ratio[symbols[:-1], symbols[1:]].mean()) if len(symbols) > 1 else 0.0


def spans_of(text: bytes, ratio: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans in code points, in order."""
    base = pattern_spans(text)
    found = [(start, kind, end) for start, kind, end, _, _ in base]
    if b"x" * MIN_LENGTH in text.translate(_MARK_RUN):
        taken = sorted((start, end) for start, _, end in found)
        reach = np.maximum.accumulate([end for _, end in taken]).tolist() if taken else []
        for m in _RUN.finditer(text):
            before = bisect_left(taken, (m.end(),))  # spans that start before the run ends
            if before and reach[before - 1] > m.start():
                continue
            mean = score(m[0], ratio)
            if mean > THRESHOLD and mean * (len(m[0]) - 1) >= LEAST_RATIO:
                found.append((m.start(), 3, m.end()))
    if not found or text.isascii():
        return sorted(found)
    octets = np.frombuffer(text, np.uint8)
    at = np.append(0, np.cumsum((octets & 0xC0) != 0x80))
    return sorted((int(at[start]), kind, int(at[end])) for start, kind, end in found)


def scan(docs: DataFrame, ratio: np.ndarray, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``spans``: an array of (kind, start, end) in order."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def make():
        def step(batch: pa.RecordBatch):
            ratio = shared.value
            spans = [
                [{"kind": KINDS[kind], "start": start, "end": end} for start, kind, end in spans_of(value, ratio)]
                for value in as_bytes(batch.column(len(keep)))
            ]
            return [*batch.columns[: len(keep)], spans]

        return step

    span = T._parse_datatype_string("array<struct<kind:string,start:int,end:int>>")
    fields = [*only(docs, *keep).schema.fields, T.StructField("spans", span)]
    return map_batches(only(docs, *keep, text), T.StructType(fields), make)
