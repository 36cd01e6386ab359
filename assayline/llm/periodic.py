"""Runs of repeated words inside texts, and texts without the repeats.

Method: an enhanced suffix array with the branching-tandem test.  The words of a batch of texts, numbered apart from text
to text, stand in one array; prefix doubling sorts its suffixes and leaves, for every power of two, the classes of
positions that begin with the same words.  From them come the LCP table and, without any tree nodes, the LCP intervals (left and
right ends by one pass with a stack).  In an interval of depth d only the suffixes of children other than the largest one
are tested: i and i + d (or i - d) both in the interval but in different children (by the inverse suffix array) make a
branching tandem, a square of period d that its next word breaks.  Squares are rotated to the left as long as the word before agrees,
in steps of powers of two, and merge into maximal runs; of the periods of one stretch the smallest stays.

A run is a stretch of words with smallest period q, at least ``REPEATS`` * q and ``SHORTEST`` words long, that no
neighbouring word extends.  Each text is worked on by itself, so there is no shuffle, and a lost task is run again.

Cases: words are split at white space (0x20, 0x09-0x0D); null, empty and blank texts have no words and no runs.  Very long texts
are taken whole, alone in their batch; memory is about 4 bytes x words x log2 of the longest repeat (in words), besides the words.  Equal
stretches at different places are different runs.  Repeated rows and null keys get a result each, and empty tables give empty
ones.  Only the text and the kept columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from assayline.llm.common import as_bytes, map_batches, only

#: A run holds its period at least so many times, and so many words at least.
REPEATS, SHORTEST = 4, 6
#: Words that are worked on together; a longer text is taken alone.
BATCH_WORDS = 1 << 18


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted suffixes, their inverse, and for every k the class of the 2 ** k symbols from each position on.

    The last symbol must occur once.  A class is named by the place of its first suffix, so classes are sorted too.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.r_[True, np.diff(symbols[order]) != 0]
    rank = np.empty(n, "int64")
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, width = [rank.astype("int32")], 1
    while True:
        open_ = np.flatnonzero(~new | ~np.r_[new[1:], True])  # places of suffixes that are not told apart yet
        if not len(open_):
            return order, rank, levels
        at = order[open_]
        keys = rank[at] * n + rank[at + width]  # what shares its first words with another suffix does not end here
        by = np.argsort(keys, kind="stable")
        order[open_] = at = at[by]
        keys = keys[by]
        first = np.r_[True, np.diff(keys) != 0]
        new[open_] = first
        rank[at] = open_[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        levels.append(rank.astype("int32"))
        width *= 2


def common_ahead(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols agree from positions ``a`` and ``b`` (different ones) on."""
    length = np.zeros(len(a), "int64")
    for k in range(len(levels) - 1, -1, -1):
        length += (levels[k][a + length] == levels[k][b + length]).astype("int64") << k
    return length


def common_behind(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols agree before positions ``a`` < ``b``."""
    length = np.zeros(len(a), "int64")
    for k in range(len(levels) - 1, -1, -1):
        x, y = a - length - (1 << k), b - length - (1 << k)
        length += ((x >= 0) & (levels[k][np.maximum(x, 0)] == levels[k][np.maximum(y, 0)])).astype("int64") << k
    return length


def _ends(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place with a positive value: the last place before and the first place after it that is smaller."""
    values = lcp.tolist()
    left, right = [0] * len(values), [len(values)] * len(values)
    stack = [0]  # the first value is -1, smaller than all
    for place in range(1, len(values)):
        value = values[place]
        while values[stack[-1]] > value:
            right[stack.pop()] = place
        top = stack[-1]
        if values[top] == value:
            left[place] = left[top]
            right[top] = -1  # the same interval: its end is that of its last place
        else:
            left[place] = top
        if value > 0:
            stack.append(place)
        else:
            stack = [0, place]
    return np.array(left), np.array(right)


def branching_tandems(order: np.ndarray, rank: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions and periods of all squares that the symbol after them breaks."""
    n = len(order)
    lcp = np.r_[-1, common_ahead(levels, order[:-1], order[1:])]
    left, right = _ends(lcp)
    cut = np.flatnonzero(lcp > 0)
    cut = cut[np.lexsort((cut, left[cut], lcp[cut]))]  # the cuts between children, interval by interval
    if not len(cut):
        return cut, cut
    depth, begin = lcp[cut], left[cut]
    opens = np.r_[True, (np.diff(depth) != 0) | (np.diff(begin) != 0)]
    # A cut opens the child at its right; the first child of an interval begins at the interval's left end.
    last = np.r_[opens[1:], True]
    stop = np.where(last, right[cut], np.r_[cut[1:], 0])  # ends are exclusive
    number = np.cumsum(opens) - 1
    starts = np.r_[cut, begin[opens]]
    stops = np.r_[stop, cut[opens]]
    owner = np.r_[number, number[opens]]
    low, high, deep = begin[opens], right[cut][last], depth[opens]
    size = stops - starts
    by = np.lexsort((-size, owner))
    small = np.ones(len(size), bool)
    small[by[np.r_[True, np.diff(owner[by]) != 0]]] = False  # the largest child is not gone through
    starts, size, owner = starts[small], size[small], owner[small]
    child = np.repeat(np.arange(len(size)), size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + starts[child]
    own, position = owner[child], order[place]
    found = []
    for sign in (1, -1):
        other = position + sign * deep[own]
        inside = (other >= 0) & (other < n)
        where = rank[np.where(inside, other, 0)]
        hit = inside & (where >= low[own]) & (where < high[own])
        hit &= (where < starts[child]) | (where >= starts[child] + size[child])
        found.append(np.stack([np.minimum(position, other)[hit], deep[own][hit]]))
    squares = np.unique(np.concatenate(found, 1), axis=1)
    return squares[0], squares[1]


def runs(symbols: np.ndarray, repeats: int = REPEATS, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (exclusive) and smallest periods of all maximal runs, by start, then period; the last symbol occurs once."""
    order, rank, levels = suffix_array(symbols)
    at, period = branching_tandems(order, rank, levels)
    start = at - common_behind(levels, at, at + period)  # all rotations of a square, merged
    end = at + 2 * period
    whole = end - start >= np.maximum(shortest, repeats * period)
    start, end, period = start[whole], end[whole], period[whole]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    smallest = np.r_[True, (np.diff(start) != 0) | (np.diff(end) != 0)][: len(start)]
    start, end, period = start[smallest], end[smallest], period[smallest]
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers that differ from text to text, each text followed by a number of its own; and the texts' starts."""
    symbols: list[int] = []
    starts, first = [], 0
    for words in texts:
        starts.append(len(symbols))
        seen: dict[bytes, int] = {}
        symbols += [seen.setdefault(word, first + len(seen)) for word in words]
        first += len(seen) + 1
        symbols.append(first - 1)
    return np.array(symbols, "int64"), np.array([*starts, len(symbols)], "int64")


def _together(texts: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    part, size = [], 0
    for words in texts:
        if part and size + len(words) > BATCH_WORDS:
            yield part
            part, size = [], 0
        part.append(words)
        size += len(words)
    if part:
        yield part


def runs_and_rest(texts: list[bytes]) -> Iterator[tuple[list[dict], bytes]]:
    """For each text its runs, and its words without those that a run holds after its first period, joined by spaces."""
    for part in _together([text.split() for text in texts]):
        symbols, bounds = _numbered(part)
        start, end, period = runs(symbols)
        if not len(start):
            yield from (([], b" ".join(words)) for words in part)
            continue
        change = np.zeros(len(symbols) + 1, "int64")
        np.add.at(change, start + period, 1)
        np.add.at(change, end, -1)
        kept = np.cumsum(change[:-1]) == 0
        cut = np.searchsorted(start, bounds)
        for i, words in enumerate(part):
            a, b = cut[i], cut[i + 1]
            if a == b:
                yield [], b" ".join(words)
                continue
            own = zip((start[a:b] - bounds[i]).tolist(), (end - start)[a:b].tolist(), period[a:b].tolist())
            stay = kept[bounds[i] : bounds[i + 1] - 1].tolist()
            yield [{"start": s, "length": n, "period": p} for s, n, p in own], b" ".join([w for w, k in zip(words, stay) if k])


def periodic_runs(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``n_words``, ``runs`` (array of start, length and period in words) and ``collapsed``, the rest of the text."""

    def make():
        def step(batch: pa.RecordBatch):
            texts = as_bytes(batch.column(len(keep)))
            found, rest = zip(*runs_and_rest(texts))
            collapsed = pa.array(rest, pa.binary()).cast(pa.string())
            return [*batch.columns[: len(keep)], [len(t.split()) for t in texts], list(found), collapsed]

        return step

    more = T._parse_datatype_string("n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return map_batches(only(df, *keep, text), T.StructType([*only(df, *keep).schema.fields, *more.fields]), make)
