"""Language-model scores of texts by a probabilistic suffix tree over words.

Method: a context is the one or two words before a token; every context of the training texts is a candidate, and the tree's states are those that
pass a divergence test: the gain in log-likelihood of their next-symbol distribution over that of their suffix (one word less, then none),
per occurrence, is ``LEAST_DIVERGENCE`` or more.  With a context its suffixes stay.  Distributions are smoothed: every word that follows a context
has an entry, which gives up ``DISCOUNT`` counts, and what entries leave goes to the distribution of the suffix, down to the root, where every word has
one count more than it has and one share is left for unknown words.  All distributions add up to one.  A token is scored by the state with the
longest context that its history ends with.  No context and no entry is left out for its count, at any size.

Distribution: the tree grows with the corpus, so it lies in groups and is never gathered.  Only the counts of the most frequent
words, 2 ** ``WORD_BITS`` of them at most (about 20 MB), are broadcast, with numbers that stand for these words.  Texts
are written once as numbers and hashes; then every token travels with its history, packed with others, to the group that its last word is dealt to.  All
occurrences of a context of either length lie there, so the group counts its entries, tests its states and scores its tokens; the sums by row travel back.
Two kinds of tokens make a stop on the way: a word that is not broadcast, in the group of all its occurrences, for its count; and a token after
a hot word (``HOT`` occurrences or more, dealt by the last two words so that no group holds all of it), in the group of that pair, for the pair's count.
The states of the hot words themselves are tested before, from the counts of their pairs.  Beyond ``GROUPS`` groups their pieces are worked on one by
one.  A piece holds about ``GROUP`` tokens, and ``HOT`` more at most unless one pair of words is that frequent.  No limit changes a result.
Words are told apart by 62 bits of hash.

Cases: A-Z are lower-cased and words split at white space (0x20, 0x09-0x0D); every text ends with one end token, which is also the context of
its first token.  Null, empty and blank texts have the end token alone.  Very long texts are read whole.  Repeated rows are counted
and scored each.  Without training texts every probability is 1.  An empty table gives an empty result.  Only the text and the kept columns are read,
so other columns may have any name; kept columns must not have the names of the results.
"""

from __future__ import annotations

import struct
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.llm.common import as_bytes, map_batches, only, written
from assayline.session import ship_package

WORD_BITS = 20
#: Words with fewer occurrences are not broadcast.
LEAST_WORD = 1
#: Nats per occurrence that a context must gain over its suffix.
LEAST_DIVERGENCE = 0.02
DISCOUNT = 0.5
#: Tokens that a task gathers before it deals them out, and words that it remembers.
BUFFER, REMEMBERED = 1 << 20, 1 << 19
#: Tokens of a group, and occurrences from which on a word's contexts are dealt to several groups.
GROUP, HOT = 1 << 20, 1 << 20
#: Groups that tokens are dealt to at most; larger ones are worked on in pieces, since parts of a few tokens do not pack well.
GROUPS = 2048
#: Binary places of sums that travel.
SCORE_BITS, BASE_BITS = 36, 44
#: Ids from here on are hashes of words, those below are numbers of frequent words; 0 stands for no word.
RARE = 1 << 62
#: Parts of a group as they travel: the group and packed columns.
PARTS = "to int, part binary"
_SEED = 42
_END = np.uint64(xxhash.xxh64_intdigest(b"", _SEED)).astype("int64")  # no word is empty


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased; on bytes, ``lower`` and ``split`` know ASCII only."""
    return text.lower().split()


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, _SEED)


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[list[bytes]]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            yield as_bytes(batch.column(0).slice(start, 256))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): the hash of every different token and its count; the end of a text is the hash of no characters."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def added() -> pa.RecordBatch:
            hashes = np.fromiter(map(_hash, counts), np.uint64, len(counts)).astype("int64")
            return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for texts in _texts(batches):
            for value in texts:
                counts.update(words_of(value))
            counts[b""] += len(texts)
            if len(counts) > REMEMBERED:
                yield added()
                counts.clear()
        if counts:
            yield added()

    return only(docs, text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Level:
    """States of one length: candidates' keys (sorted), what goes to the suffix (0: no state), and entries key << 21 | word."""

    keys: np.ndarray
    rest: np.ndarray
    entries: np.ndarray
    shares: np.ndarray

    def share(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Discounted probability of a word's entry, 0 where there is none."""
        return _found(self.entries, self.shares, state << 21 | word, 0.0)


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), otherwise)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], otherwise)


@dataclass(frozen=True)
class Head:
    """Frequent words (hashes in order, their numbers from 1 by falling count) and root counts."""

    tokens: int
    distinct: int
    hashes: np.ndarray
    numbers: np.ndarray
    counts: np.ndarray  # by number; 0 stands for all other words

    def chance(self, n: np.ndarray) -> np.ndarray:
        """The root's probability of a word that occurs ``n`` times."""
        return (n + 1.0) / (self.tokens + self.distinct + 1)

    def root(self, word: np.ndarray) -> np.ndarray:
        return self.chance(self.counts[word])

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of frequent words; others keep 62 bits of their hash."""
        numbers = _found(self.hashes, self.numbers, hashes, 0).astype("int64")
        return np.where(numbers > 0, numbers, (hashes.view("uint64") >> np.uint64(2)).view("int64") | RARE)

    @property
    def end(self) -> int:
        return int(self.ids(np.array([_END]))[0])

    @property
    def hot(self) -> int:
        """How many words are hot; they have the smallest numbers."""
        return int((self.counts[1:] >= HOT).sum())


@dataclass(frozen=True)
class Model(Head):
    """Root counts, and the training texts, whose contexts are counted where they meet the texts to be scored."""

    docs: DataFrame
    text: str

    @property
    def head(self) -> Head:
        return Head(self.tokens, self.distinct, self.hashes, self.numbers, self.counts)

    @property
    def contexts(self) -> int:
        """How many words with a number are candidate contexts: all."""
        return len(self.hashes)

    @cached_property
    def gathered(self) -> tuple[Level, Level]:
        """The states of both lengths in one place, to look at those of a small corpus."""
        if self.distinct > min(self.contexts, (1 << 17) - 1):
            raise ValueError("too many words to gather their contexts")
        rows = states(self).toArrow()
        second, first, word, share, rest, stays = (rows.column(i).to_numpy() for i in range(6))
        longer = second > 0
        one, two = np.flatnonzero(~longer), np.flatnonzero(longer)
        none = np.zeros(0, "int64")
        pairs = second[two] << 17 | first[two]
        keys = np.unique(pairs)
        levels = []
        for at, state, size, own in ((one, first[one], self.contexts, none), (two, np.searchsorted(keys, pairs) + 1, len(keys), keys)):
            left = np.zeros(size + 1)
            left[state] = np.where(stays[at], rest[at], 0.0)
            entries, shares = (state << 21 | word[at])[stays[at]], share[at][stays[at]]
            order = np.argsort(entries)
            levels.append(Level(own, left, entries[order], shares[order]))
        return levels[0], levels[1]

    @property
    def one(self) -> Level:
        return self.gathered[0]

    @property
    def two(self) -> Level:
        return self.gathered[1]

    def pair(self, second: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Number (from 1) of the candidate context of two words, 0 if there is none."""
        numbers = np.arange(1, len(self.two.keys) + 1)
        return _found(self.two.keys, numbers, second << 17 | first, 0).astype("int64")

    def probabilities(self, second: np.ndarray, first: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of tokens after their last two words, by the gathered states: a part that does not depend on the root's, and the root's factor."""
        stays = self.one.rest[first] > 0
        own = np.where(stays, self.one.share(first, word), 0.0)
        rest = np.where(stays, self.one.rest[first], 1.0)
        pair = self.pair(second, first)
        at = np.flatnonzero((pair > 0) & (self.two.rest[pair] > 0))
        below = self.two.rest[pair[at]]
        own[at] = self.two.share(pair[at], word[at]) + below * own[at]
        rest[at] *= below
        return own, rest


class Reader:
    """Words to ids, see :meth:`Head.ids`."""

    def __init__(self, head: Head) -> None:
        self.head = head
        self._restart()

    def _restart(self) -> None:
        self.known: dict[bytes, int] = defaultdict(count().__next__)  # words in the order in which they are met
        self.ids = np.zeros(0, "int64")

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all tokens of the texts, and the number of each text's tokens."""
        if len(self.known) > REMEMBERED:
            self._restart()
        words: list[bytes] = []
        ends = [0]
        for value in texts:
            words += words_of(value)
            words.append(b"")
            ends.append(len(words))
        met = np.fromiter(map(self.known.__getitem__, words), "int64", len(words))
        before = len(self.ids)
        if len(self.known) > before:
            new = map(_hash, islice(self.known, before, None))
            hashes = np.fromiter(new, np.uint64, len(self.known) - before).astype("int64")
            self.ids = np.r_[self.ids, self.head.ids(hashes)]
        return self.ids[met], np.diff(ends)


# ---- columns as they travel


def packed(*columns: np.ndarray) -> bytes:
    """Columns of integers or doubles, byte by byte of all values, compressed."""
    out = []
    for column in columns:
        values, width = column, 8
        if column.dtype.kind != "f":
            values = column.astype("<i8", copy=False)
            low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
            width = 8 if low < 0 else (high.bit_length() + 7) // 8
        planes = np.ascontiguousarray(np.ascontiguousarray(values).view("u1").reshape(-1, 8)[:, :width].T)
        data = pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if width and len(values) else b""
        out += [struct.pack("<IBBI", len(values), width, column.dtype.kind == "f", len(data)), data]
    return b"".join(out)


def unpacked(part: bytes) -> list[np.ndarray]:
    """The columns that were packed."""
    columns, at = [], 0
    while at < len(part):
        size, width, real, length = struct.unpack_from("<IBBI", part, at)
        at += 10
        values = np.zeros((size, 8), "u1")
        if length:
            raw = pa.decompress(part[at : at + length], decompressed_size=size * width, codec="zstd", asbytes=True)
            values[:, :width] = np.frombuffer(raw, "u1").reshape(width, size).T
        columns.append(values.view("<f8" if real else "<i8").ravel())
        at += length
    return columns


def _fixed(x: np.ndarray, bits: int) -> np.ndarray:
    """Doubles as integers of so many binary places, where they have room; takes fewer bytes."""
    return np.rint(np.ldexp(x, bits)).astype("int64") if len(x) and np.abs(x).max() < 1 << 62 - bits else x


def _double(x: np.ndarray, bits: int) -> np.ndarray:
    return x if x.dtype.kind == "f" else np.ldexp(x.astype(float), -bits)


def _split(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rare = ids >= RARE
    return np.where(rare, 0, ids + 1), ids[rare]


def _joined(small: np.ndarray, rare: np.ndarray) -> np.ndarray:
    ids = small - 1
    ids[small == 0] = rare
    return ids


@dataclass(frozen=True)
class Tokens:
    """Tokens with their histories: row, flags (1: learnt from, 2: scored), the second-last and the last word before, the word; the count
    of a word that is not broadcast, and of a pair whose first word is hot, where known."""

    row: np.ndarray
    flags: np.ndarray
    second: np.ndarray
    first: np.ndarray
    word: np.ndarray
    n_word: np.ndarray
    n_pair: np.ndarray

    def columns(self) -> list[np.ndarray]:
        return list(vars(self).values())

    def take(self, at: np.ndarray | slice) -> Tokens:
        return Tokens(*[x[at] for x in self.columns()])

    def pack(self) -> bytes:
        ids = [x for column in (self.second, self.first, self.word) for x in _split(column)]
        return packed(self.row[:1], np.diff(self.row), self.flags, *ids, self.n_word, self.n_pair)

    @staticmethod
    def unpack(part: bytes) -> Tokens:
        row, step, flags, *ids, n_word, n_pair = unpacked(part)
        ids = [_joined(*ids[i : i + 2]) for i in (0, 2, 4)]
        return Tokens(np.cumsum(np.r_[row, step]), flags.astype("int8"), *ids, n_word.astype("int32"), n_pair)

    @staticmethod
    def together(tokens: list[Tokens]) -> Tokens:
        """All tokens; the list is emptied, a column at a time."""
        parts = [t.columns() for t in tokens]
        tokens.clear()
        return Tokens(*[np.concatenate([columns.pop(0) for columns in parts]) for _ in range(len(parts[0]))])


@dataclass(frozen=True)
class Deal:
    """Groups, each of so many pieces."""

    groups: int
    pieces: int

    @staticmethod
    def over(tokens: int) -> Deal:
        n = max(-(-tokens // GROUP), min(32, tokens >> 16), 1)
        pieces = -(-n // GROUPS)
        return Deal(-(-n // pieces), pieces)

    def place(self, *ids: np.ndarray) -> np.ndarray:
        """A piece for each value, by its bits alone; those of a group are neighbours."""
        h = np.zeros(len(ids[0]), "uint64")
        for x in ids:
            h = (h ^ x.astype("uint64")) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        h = (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
        places = self.groups * self.pieces
        return (h % np.uint64(places)).astype("uint16" if places <= 1 << 16 else "int64")

    def packed(self, tokens: Tokens, places: np.ndarray) -> dict[str, pa.Array]:
        """The tokens' parts of all groups."""
        found = [(group, tokens.take(at).pack()) for group, at in _parts(places // self.pieces)]
        return {"to": pa.array([group for group, _ in found], pa.int32()), "part": pa.array([part for _, part in found], pa.binary())}

    def read(self, group: pa.Table, place: Callable[[Tokens], np.ndarray]) -> Iterator[Tokens]:
        """The tokens of a group, piece by piece."""
        parts = group.column("part").to_pylist()
        if self.pieces == 1:
            yield Tokens.together([Tokens.unpack(part) for part in parts])
            return
        pieces: dict[int, list[bytes]] = defaultdict(list)
        some, size = [], 0
        while parts:
            some.append(Tokens.unpack(parts.pop()))
            size += len(some[-1].row)
            if size > BUFFER or not parts:
                tokens = Tokens.together(some)
                for piece, at in _parts(place(tokens) % self.pieces):
                    pieces[piece].append(tokens.take(at).pack())
                size = 0
        while pieces:
            yield Tokens.together([Tokens.unpack(part) for part in pieces.popitem()[1]])


def _parts(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every group that is named and where."""
    order = np.argsort(to, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(to[order].astype("int64")) != 0, True]) if len(to) else []
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(to[order[a]]), order[a:b]


# ---- texts to tokens to groups


@dataclass(frozen=True)
class Dealing:
    """How tokens are dealt to groups, and before to stops."""

    groups: Deal
    stops: Deal
    hot: int
    end: int

    def stopping(self, t: Tokens) -> np.ndarray:
        """Tokens that learn a count on the way."""
        return (t.word >= RARE) | (t.first <= self.hot)

    def stop(self, first: np.ndarray, word: np.ndarray) -> np.ndarray:
        return np.where(word >= RARE, self.stops.place(word), self.stops.place(word, first))

    def group(self, t: Tokens) -> np.ndarray:
        return np.where(t.first <= self.hot, self.groups.place(t.first, t.second), self.groups.place(t.first))


def _read(docs: DataFrame, shared, text: str, keep: tuple[str, ...], learnt: Column, scored: bool) -> DataFrame:
    """A written table: columns ``keep``, ``_row``, sums over frequent words, and, in the first of every few rows, the packed tokens of these rows."""

    def make():
        reader = Reader(shared.value)

        def step(batch: pa.RecordBatch):
            ids, lengths = reader.read(as_bytes(batch.column(len(keep))))
            starts = np.cumsum(lengths) - lengths
            flags = batch.column(len(keep) + 1).to_numpy(zero_copy_only=False).astype("int64") | 2 * scored
            frequent = ids < RARE
            base = np.where(frequent, np.log10(reader.head.root(np.where(frequent, ids, 0))), 0.0)
            known = np.add.reduceat(frequent.astype("int64"), starts)
            part = packed(lengths, flags, *_split(ids))
            return [*batch.columns[: len(keep)], lengths, known, np.add.reduceat(base, starts), [part] + [None] * (len(lengths) - 1)]

        return step

    rows = docs.select(*[F.col(f"`{c}`") for c in (*keep, text)], learnt.cast("int").alias("_learnt"))
    more = T._parse_datatype_string("n_tokens long, n_known long, base_score double, _part binary")
    rows = map_batches(rows, T.StructType([*only(docs, *keep).schema.fields, *more.fields]), make)
    return written(rows.withColumn("_row", F.monotonically_increasing_id()), "tokens")


def _parts_of(table: DataFrame) -> DataFrame:
    return table.where(F.col("_part").isNotNull()).select("_row", "_part")


def _buffered(batches: Iterable[pa.RecordBatch], dealing: Dealing, wanted, dealt) -> Iterator[pa.RecordBatch]:
    """What ``dealt`` makes of the wanted tokens of written rows, a buffer at a time."""
    parts, size = [], 0
    for batch in batches:
        for row, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lengths, flags, *ids = unpacked(part)
            word = _joined(*ids)
            starts = np.cumsum(lengths) - lengths
            first = np.r_[dealing.end, word[:-1]]
            first[starts] = dealing.end
            second = np.r_[0, first[:-1]]
            second[starts] = 0
            nothing = np.zeros(len(word), "int8")
            rows = np.repeat(row + np.arange(len(lengths)), lengths)
            tokens = Tokens(rows, np.repeat(flags, lengths).astype("int8"), second, first, word, nothing, nothing)
            tokens = tokens.take(wanted(tokens))
            if len(tokens.row):
                parts.append(tokens)
                size += len(tokens.row)
            if size > BUFFER:
                yield dealt(parts)
                parts, size = [], 0
    if size:
        yield dealt(parts)


def _sent(table: DataFrame, dealing: Dealing, stopping: bool) -> DataFrame:
    """Tokens that make a stop, dealt to their stops, or the others, dealt to their groups."""

    def dealt(parts: list[Tokens]) -> pa.RecordBatch:
        t = Tokens.together(parts)
        found = dealing.stops.packed(t, dealing.stop(t.first, t.word)) if stopping else dealing.groups.packed(t, dealing.group(t))
        return pa.RecordBatch.from_pydict(found)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _buffered(batches, dealing, lambda t: dealing.stopping(t) == stopping, dealt)

    return _parts_of(table).mapInArrow(run, PARTS)


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted columns: where a new run of equal values begins, and the number of each value's run."""
    new = np.r_[True, np.zeros(len(columns[0]) - 1, bool)]
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _at_stop(group: pa.Table, dealing: Dealing) -> Iterator[Tokens]:
    """The tokens of a stop by word, then the word before, with the counts that they lacked."""
    for t in dealing.stops.read(group, lambda t: dealing.stop(t.first, t.word)):
        t = t.take(np.lexsort((t.first, t.word)))
        learnt = (t.flags & 1).astype("int64")
        counts = []
        for columns, wanted in (((t.word,), t.word >= RARE), ((t.word, t.first), t.first <= dealing.hot)):
            starts, run = _runs(*columns)
            counts.append(np.where(wanted, np.add.reduceat(learnt, starts)[run], 0))
        yield Tokens(t.row, t.flags, t.second, t.first, t.word, *counts)


def _stopped(sent: DataFrame, dealing: Dealing) -> DataFrame:
    """Tokens that made their stop, dealt to their groups."""

    def run(group: pa.Table) -> pa.Table:
        return pa.concat_tables([pa.table(dealing.groups.packed(t, dealing.group(t))) for t in _at_stop(group, dealing)])

    return sent.groupBy("to").applyInArrow(run, PARTS)


# ---- states


@dataclass(frozen=True)
class HotStates:
    """Of hot words, by number: occurrences, what a context gives to the root, and whether it stays."""

    totals: np.ndarray
    rest: np.ndarray
    stays: np.ndarray


#: Entries of hot words with the same counts: the hot word, the count of the pair, that of the next word, and how many entries.
_ALIKE = "word long, n long, n_next long, times long"


def _alike(first: np.ndarray, n: np.ndarray, n_next: np.ndarray) -> pa.Table:
    order = np.lexsort((n_next, n, first))
    columns = [x[order] for x in (first, n, n_next)]
    starts = _runs(*columns)[0] if len(order) else order
    return pa.table([*[x[starts] for x in columns], np.diff(np.r_[starts, len(order)])], names=["word", "n", "n_next", "times"])


def _hot_pairs(table: DataFrame, dealing: Dealing) -> DataFrame:
    """Counts of hot words with the next word, added up per buffer, dealt as at the stops."""

    def dealt(parts: list[Tokens]) -> pa.RecordBatch:
        first, word = (np.concatenate([getattr(t, name) for t in parts]) for name in ("first", "word"))
        order = np.lexsort((word, first))
        first, word = first[order], word[order]
        starts, _ = _runs(first, word)
        n = np.diff(np.r_[starts, len(order)])
        first, word = first[starts], word[starts]
        to = dealing.stop(first, word) // dealing.stops.pieces
        found = [(group, packed(first[at], *_split(word[at]), n[at])) for group, at in _parts(to)]
        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in found], pa.int32()), pa.array([p for _, p in found], pa.binary())], names=["to", "part"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _buffered(batches, dealing, lambda t: (t.flags & 1 > 0) & (t.first <= dealing.hot), dealt)

    return _parts_of(table).mapInArrow(run, PARTS)


def _hot_states(rows: DataFrame, head: Head) -> HotStates:
    """States of hot words after their own divergence test."""
    rows = written(rows, "hot")
    n, times = F.col("n"), F.col("times")
    own = rows.groupBy("word").agg(F.sum(n * times).alias("total"), F.sum(times).alias("entries"))
    root = (F.col("n_next") + 1) / F.lit(float(head.tokens + head.distinct + 1))
    rest = DISCOUNT * F.col("entries") / F.col("total")
    gain = F.sum(times * n * F.log(((n - DISCOUNT) / F.col("total") + rest * root) / root))
    found = rows.join(F.broadcast(own), "word").groupBy("word", "total", "entries").agg(gain.alias("gain")).collect()
    totals, left, stays = np.zeros(head.hot + 1), np.ones(head.hot + 1), np.zeros(head.hot + 1, bool)
    for r in found:
        totals[r["word"]], left[r["word"]] = r["total"], DISCOUNT * r["entries"] / r["total"]
        stays[r["word"]] = r["gain"] >= LEAST_DIVERGENCE * r["total"]
    return HotStates(totals, left, stays)


def _classes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values, and the place of each value among them."""
    values, place = np.unique(x, return_inverse=True)
    return values, place.astype("int32")


@dataclass(frozen=True)
class Group:
    """States of a group's contexts: classes of words before, of words, of pairs (of a word and the next), of contexts of two words, and of both with the next word."""

    firsts: np.ndarray
    words: np.ndarray
    seconds: np.ndarray
    pair_first: np.ndarray  # of each pair
    pair_word: np.ndarray
    n_pair: np.ndarray
    context_first: np.ndarray  # of each context of two words
    context_second: np.ndarray
    triple_context: np.ndarray  # of each triple
    triple_pair: np.ndarray
    n_triple: np.ndarray
    triple: np.ndarray  # of each token
    root: np.ndarray  # of each word
    share: np.ndarray  # of each pair
    rest: np.ndarray  # of each first word
    stays: np.ndarray
    longer_share: np.ndarray  # of each triple
    longer_rest: np.ndarray  # of each context of two words
    longer_stays: np.ndarray

    def chances(self) -> np.ndarray:
        """The probability of each triple's word after the two others."""
        root, first = self.root[self.pair_word], self.pair_first
        below = np.where(self.stays[first], self.share + self.rest[first] * root, root)[self.triple_pair]
        context = self.triple_context
        return np.where(self.longer_stays[context], self.longer_share + self.longer_rest[context] * below, below)


def _shares(n: np.ndarray, state: np.ndarray, totals: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Discounted probabilities of entries, and what their states give to the suffix."""
    total = np.maximum(totals, 1)
    return np.where(n > 0, (n - DISCOUNT) / total[state], 0.0), np.where(totals > 0, DISCOUNT * entries / total, 1.0)


def _states(t: Tokens, head: Head, hot: HotStates) -> Group:
    learnt = (t.flags & 1).astype(float)
    words, word = _classes(t.word)
    firsts, first = _classes(t.first)
    seconds, second = _classes(t.second)
    pairs, pair = _classes(first.astype("int64") * len(words) + word)
    pair_first, pair_word = (x.astype("int32") for x in np.divmod(pairs, len(words)))
    contexts, context = _classes(first.astype("int64") * len(seconds) + second)
    context_first, context_second = (x.astype("int32") for x in np.divmod(contexts, len(seconds)))
    triples, triple = _classes(context.astype("int64") * len(words) + word)
    triple_context = (triples // len(words)).astype("int32")
    triple_pair = np.zeros(len(triples), "int32")
    triple_pair[triple] = pair

    frequent = words < RARE
    n_word = np.zeros(len(words))
    n_word[word] = t.n_word
    root = head.chance(np.where(frequent, head.counts[np.where(frequent, words, 0)], n_word))

    n_pair = np.bincount(pair, learnt, len(pairs))
    totals = np.bincount(first, learnt, len(firsts))
    entries = np.bincount(pair_first[n_pair > 0], minlength=len(firsts)).astype(float)
    is_hot = firsts < len(hot.totals)
    if is_hot.any():
        given = np.zeros(len(pairs))
        given[pair] = t.n_pair
        n_pair = np.where(is_hot[pair_first], given, n_pair)
        totals[is_hot] = hot.totals[firsts[is_hot]]
    share, rest = _shares(n_pair, pair_first, totals, entries)
    if is_hot.any():
        rest[is_hot] = hot.rest[firsts[is_hot]]
    below, above = root[pair_word], share + rest[pair_first] * root[pair_word]
    gain = np.bincount(pair_first, n_pair * np.log(above / below), len(firsts))
    stays = (totals > 0) & (gain >= LEAST_DIVERGENCE * totals)
    if is_hot.any():
        stays[is_hot] = hot.stays[firsts[is_hot]]

    n_triple = np.bincount(triple, learnt, len(triples))
    longer = np.bincount(context, learnt, len(contexts))
    entries = np.bincount(triple_context[n_triple > 0], minlength=len(contexts)).astype(float)
    longer_share, longer_rest = _shares(n_triple, triple_context, longer, entries)
    below = above[triple_pair]
    gain = np.bincount(triple_context, n_triple * np.log((longer_share + longer_rest[triple_context] * below) / below), len(contexts))
    longer_stays = (longer > 0) & (seconds[context_second] > 0) & (gain >= LEAST_DIVERGENCE * longer)
    stays[context_first[longer_stays]] = True  # with a context its suffix stays
    return Group(
        firsts, words, seconds, pair_first, pair_word, n_pair, context_first, context_second, triple_context, triple_pair, n_triple, triple,
        root, share, rest, stays, longer_share, longer_rest, longer_stays,
    )


class Meeting:
    """Tokens of written tables, dealt to the groups in which the contexts of the model are."""

    def __init__(self, tables: list[DataFrame], model: Model, shared) -> None:
        tokens, stopping = 0, 0
        for table in tables:
            n, frequent = table.agg(F.sum("n_tokens"), F.sum("n_known")).first()
            tokens, stopping = tokens + (n or 0), stopping + (n or 0) - (frequent or 0)
        hot = model.hot
        if hot:
            stopping += tokens * int(model.counts[1 : hot + 1].sum()) // model.tokens
        self.shared, self.dealing = shared, Dealing(Deal.over(tokens), Deal.over(stopping), hot, model.end)
        sent = self._union([_sent(table, self.dealing, True) for table in tables])
        direct = [_sent(table, self.dealing, False) for table in tables]
        self.tokens = self._union([*direct, _stopped(sent, self.dealing)])
        none = np.zeros(1)
        self.hot = HotStates(none, none, none > 0)
        if hot:
            self._test_hot(tables, sent)

    @staticmethod
    def _union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return out

    def _test_hot(self, tables: list[DataFrame], sent: DataFrame) -> None:
        """The states of hot words; where a bound of their gain does not decide, from the counts at the stops."""
        shared, dealing = self.shared, self.dealing
        most = int(shared.value.counts[-1])  # of words that are not broadcast

        def bounded(group: pa.Table) -> pa.Table:
            first, small, rare, n = map(np.concatenate, zip(*map(unpacked, group.column("part").to_pylist())))
            word = _joined(small, rare)
            order = np.lexsort((word, first))
            first, word = first[order], word[order]
            starts, _ = _runs(first, word)
            word = word[starts]
            n_next = np.where(word < RARE, shared.value.counts[np.where(word < RARE, word, 0)], most)
            return _alike(first[starts], np.add.reduceat(n[order], starts), n_next)

        def exact(group: pa.Table) -> pa.Table:
            found = []
            for t in _at_stop(group, dealing):
                t = t.take(_runs(t.word, t.first)[0])
                t = t.take((t.first <= dealing.hot) & (t.n_pair > 0))
                found.append(_alike(t.first, t.n_pair, np.where(t.word < RARE, shared.value.counts[np.where(t.word < RARE, t.word, 0)], t.n_word)))
            return pa.concat_tables(found)

        pairs = self._union([_hot_pairs(table, self.dealing) for table in tables])
        self.hot = _hot_states(pairs.groupBy("to").applyInArrow(bounded, _ALIKE), shared.value)
        if not self.hot.stays[1:].all():
            self.hot = _hot_states(sent.groupBy("to").applyInArrow(exact, _ALIKE), shared.value)
        if not self.hot.stays[1:].all():
            self._keep_suffixes()

    def _keep_suffixes(self) -> None:
        """A hot word that fails its own test stays if a longer context that ends with it stays, in whichever group."""
        shared, hot, dealing = self.shared, self.hot, self.dealing

        def run(group: pa.Table) -> pa.Table:
            found = [_states(t, shared.value, hot) for t in dealing.groups.read(group, dealing.group)]
            return pa.table({"word": np.unique(np.concatenate([g.firsts[g.stays & (g.firsts < len(hot.totals))] for g in found]))})

        for r in self.tokens.groupBy("to").applyInArrow(run, "word long").distinct().collect():
            self.hot.stays[r["word"]] = True

    def states(self) -> DataFrame:
        shared, hot, dealing = self.shared, self.hot, self.dealing

        def piece(t: Tokens) -> pa.Table:
            g = _states(t, shared.value, hot)
            one, two = np.flatnonzero(g.n_pair > 0), np.flatnonzero((g.n_triple > 0) & (g.seconds[g.context_second] > 0)[g.triple_context])
            first, context = g.pair_first[one], g.triple_context[two]
            return pa.table({
                "second": np.r_[np.zeros(len(one), "int64"), g.seconds[g.context_second[context]]],
                "first": np.r_[g.firsts[first], g.firsts[g.context_first[context]]],
                "word": np.r_[g.words[g.pair_word[one]], g.words[g.pair_word[g.triple_pair[two]]]],
                "share": np.r_[g.share[one], g.longer_share[two]],
                "rest": np.r_[g.rest[first], g.longer_rest[context]],
                "stays": np.r_[g.stays[first], g.longer_stays[context]],
            })

        def run(group: pa.Table) -> pa.Table:
            return pa.concat_tables([piece(t) for t in dealing.groups.read(group, dealing.group)])

        columns = "second long, first long, word long, share double, rest double, stays boolean"
        return self.tokens.groupBy("to").applyInArrow(run, columns).distinct()  # entries of hot words are in several groups

    def sums(self) -> DataFrame:
        """(_row, score, base, known): of all tokens, and of the words that are not broadcast."""
        shared, hot, dealing = self.shared, self.hot, self.dealing
        homes = Deal(dealing.groups.groups * dealing.groups.pieces // 2 + 1, 1)

        def piece(t: Tokens) -> tuple[np.ndarray, ...]:
            g = _states(t, shared.value, hot)
            at = np.flatnonzero(t.flags & 2)
            lost = -np.log10(g.chances())[g.triple[at]]
            rare = t.word[at] >= RARE
            n = np.where(rare, t.n_word[at], 0)
            base = np.where(rare, -np.log10(shared.value.chance(n)), 0.0)
            return added_up(t.row[at], lost, base, n > 0)

        def added_up(row: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
            rows, place = _classes(row)
            return rows, *[np.bincount(place, x, len(rows)) for x in values]

        def scores(group: pa.Table) -> pa.Table:
            pieces = [piece(t) for t in dealing.groups.read(group, dealing.group)]
            rows, score, base, known = added_up(*map(np.concatenate, zip(*pieces))) if len(pieces) > 1 else pieces[0]
            found = [
                (home, packed(rows[i][:1], np.diff(rows[i]), _fixed(score[i], SCORE_BITS), _fixed(base[i], BASE_BITS), known[i].astype("int64")))
                for home, i in _parts(homes.place(rows >> 10))
            ]
            return pa.table({"to": pa.array([home for home, _ in found], pa.int32()), "part": pa.array([part for _, part in found], pa.binary())})

        def added(group: pa.Table) -> pa.Table:
            first, step, score, base, known = zip(*map(unpacked, group.column("part").to_pylist()))
            row = np.concatenate([np.cumsum(np.r_[a, b]) for a, b in zip(first, step)])
            score, base = (np.concatenate([_double(x, bits) for x in parts]) for parts, bits in ((score, SCORE_BITS), (base, BASE_BITS)))
            rows, score, base, known = added_up(row, score, base, np.concatenate(known))
            return pa.table([rows, -score, -base, known.astype("int64")], names=["_row", "_score", "_base", "_known"])

        sent = self.tokens.groupBy("to").applyInArrow(scores, PARTS)
        return sent.groupBy("to").applyInArrow(added, "_row long, _score double, _base double, _known long")


# ---- interface


def train(docs: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """The model of all texts of ``docs``, and the counts (word, n) of all words."""
    ship_package(docs.sparkSession)
    words = written(word_counts(docs, text), "words")
    tokens, distinct = words.agg(F.sum("n"), F.count("*")).first()
    tokens = tokens or 0
    least, room = LEAST_WORD, 1 << WORD_BITS
    for n, same in words.groupBy("n").count().where(F.col("n") >= LEAST_WORD).orderBy(F.desc("n")).collect():
        room -= same
        if room < 0:
            least = n + 1
            break
    rows = words.where(F.col("n") >= least).select("word", "n").toArrow()
    hashes, counts = (rows.column(i).to_numpy().astype("int64") for i in (0, 1))
    order = np.lexsort((hashes, -counts))
    hashes, counts = hashes[order], np.r_[0, counts[order]]
    by = np.argsort(hashes)
    return Model(tokens, distinct, hashes[by], (by + 1).astype("int32"), counts, docs, text), words


def states(model: Model) -> DataFrame:
    """The tree, a row for each entry of each candidate: ``second`` (0: none) and ``first``, the ids of its words, ``word``, ``share`` (the entry's
    discounted probability), ``rest`` (what goes to the suffix) and ``stays`` (whether the candidate is a state)."""
    shared = model.docs.sparkSession.sparkContext.broadcast(model.head)
    return Meeting([_read(model.docs, shared, model.text, (), F.lit(True), False)], model, shared).states()


def scored(
    docs: DataFrame, model: Model, words: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), learnt: Column | None = None
) -> DataFrame:
    """Columns ``keep``, ``n_tokens``, ``n_known``, ``base_score`` (root alone) and ``score`` of every text, as log10.

    ``learnt`` marks the rows of ``docs`` that are the model's training texts, all of them; without it the training texts are read apart.
    ``words`` are the counts of :func:`train`; those that are not in the model are counted anew where the words meet.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.head)
    rows = _read(docs, shared, text, keep, F.lit(False) if learnt is None else learnt, True)
    apart = [] if learnt is not None else [_read(model.docs, shared, model.text, (), F.lit(True), False)]
    sums = Meeting([rows, *apart], model, shared).sums()
    out = rows.drop("_part").join(sums, "_row", "left")
    return out.select(
        *[F.col(f"`{k}`") for k in keep], "n_tokens", (F.col("n_known") + F.col("_known")).alias("n_known"),
        (F.col("base_score") + F.col("_base")).alias("base_score"), F.col("_score").alias("score"),
    )


def held_out(key: str = "doc_id") -> Column:
    """Rows that are not learnt from; a null key is learnt from."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 7 == 2, F.lit(False))
