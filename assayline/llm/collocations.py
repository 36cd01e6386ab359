"""Collocations: phrases of two or three words that occur together more than their parts suggest, per language.

Method: HAT-trie counting.  A task numbers words and keeps, under each language and first word, a hash container of the up to two
words that follow in the same piece of text; a container that grows beyond ``BURST`` entries bursts into one container per second
word, so the trie stays shallow.  Every word occurrence is entered once, with what follows it; counts of shorter phrases are sums
over subtrees.  When a task holds ``MOST_ENTRIES`` entries, its largest subtrees are spilled whole: as sorted runs, one for each
partition of prefixes (language and first two words), packed.  The runs of a prefix partition meet by a shuffle and are merged;
phrases below the minimum are dropped only there, where their counts are complete.  What a hot word or pair sends
to a partition is bounded by the different phrases that each task saw, and prefixes of two words spread a hot first word.
Totals of single words travel in the same runs.  Candidates then meet the counts of their parts in shuffle joins of
frequent phrases alone; the best of a language are taken in two steps, so no task sorts a whole language.

Counts and scores are exact: sums of longs, and products as decimals of 38 digits (counts up to 10 ** 15).

Cases: A-Z are lower-cased; texts are cut into pieces at ``. , ; : ! ?`` and line ends (0x0A-0x0D), pieces into words at spaces and
tabs.  Null and empty texts have no words, a null language is ``und``.  Very long texts and pieces are read whole.  Repeated rows count
each.  Ties are ordered by score, count, then phrase (bytes), which is total.  An empty table, or one without candidates, gives
an empty result.  Only the text and the language are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections import _count_elements, defaultdict  # the counting loop of Counter, without its objects
from collections.abc import Iterable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.llm.common import as_bytes, only, written
from assayline.session import ship_package

#: Entries of a container before it bursts, entries of a task before subtrees are spilled, words that it numbers at a time.
BURST, MOST_ENTRIES, MOST_WORDS = 4096, 1 << 19, 1 << 19
#: Words that are entered before the size of the trie is looked at.
MOST_TOKENS = 1 << 18
#: Bytes of text per partition of prefixes.
PARTITION_BYTES = 4 << 20
LEAST_COUNT, TOP = 10, 2000
#: A phrase is dropped if a longer candidate holds it and has at least this share of its count, in hundredths.
COVERED = 50
_PIECES = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
_LOW = (1 << 32) - 1
_SALTS = 64


class Burst(dict):
    """Containers (third -> count) by second word, instead of one container that had grown too large."""


class HatTrie:
    """Counts of (first word, up to two words that follow it) for one language, with words as numbers; 0 is no word.

    Under each first word lies a container (second << 32 | third -> count) or, after a burst, a container (third -> count) per second word.
    """

    def __init__(self) -> None:
        self.root: dict[int, dict] = {}
        self.entries = 0

    def add(self, ids: np.ndarray) -> None:
        """Enter a sequence of words; two zeros stand after each piece of text."""
        first, keys = ids[:-2], ids[1:-1] << 32 | ids[2:]
        first, keys = first[first > 0], keys[first > 0]
        by = np.argsort(first, kind="stable")
        first, keys = first[by], keys[by]
        cuts = np.flatnonzero(np.diff(first)) + 1
        bounds = [0, *cuts.tolist(), len(first)] if len(first) else []
        listed = keys.tolist()
        for start, stop, word in zip(bounds, bounds[1:], first[bounds[:-1]].tolist()):
            box = self.root.get(word)
            if box is None:
                box = self.root[word] = {}
            elif type(box) is Burst:
                self._below(box, np.sort(keys[start:stop]))
                continue
            size = len(box)
            _count_elements(box, listed[start:stop])
            self.entries += len(box) - size
            if len(box) > BURST:
                self._burst(word, box)

    def _burst(self, word: int, box: dict[int, int]) -> None:
        apart = Burst()
        for key, n in box.items():
            apart.setdefault(key >> 32, {})[key & _LOW] = n
        self.root[word] = apart

    def _below(self, boxes: Burst, keys: np.ndarray) -> None:
        second, third = keys >> 32, (keys & _LOW).tolist()
        bounds = [0, *(np.flatnonzero(np.diff(second)) + 1).tolist(), len(keys)]
        for start, stop, word in zip(bounds, bounds[1:], second[bounds[:-1]].tolist()):
            box = boxes.setdefault(word, {})
            size = len(box)
            _count_elements(box, third[start:stop])
            self.entries += len(box) - size

    def largest(self, share: float) -> list[int]:
        """First words of the largest subtrees, with ``share`` of all entries or more together."""
        words = np.fromiter(self.root, "int64", len(self.root))
        sizes = np.fromiter((sum(map(len, b.values())) if type(b) is Burst else len(b) for b in self.root.values()), "int64", len(words))
        by = np.argsort(-sizes, kind="stable")
        before = np.cumsum(sizes[by]) - sizes[by]
        return words[by][before < share * self.entries].tolist()

    def take(self, words: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Remove whole subtrees: first word, key and count of their entries, subtree by subtree."""
        keys: list[int] = []
        counts: list[int] = []
        sizes = []
        for word in words:
            box, size = self.root.pop(word), len(keys)
            if type(box) is Burst:
                for second, below in box.items():
                    keys += [second << 32 | third for third in below]
                    counts += below.values()
            else:
                keys += box
                counts += box.values()
            sizes.append(len(keys) - size)
        self.entries -= len(keys)
        return np.repeat(np.array(words, "int64"), sizes), np.array(keys, "int64"), np.array(counts, "int64")


def _sorted_runs(trie: HatTrie, subtrees: list[int], lang: str, words: list[bytes], hashes: np.ndarray, partitions: int) -> Iterator[tuple[int, str, int, bytes]]:
    """(partition, language, bytes, packed run): lines ``first second third<tab>count``, or ``word<tab>count`` for a word by itself."""
    if not subtrees:
        return
    first, keys, counts = trie.take(subtrees)
    second, third = keys >> 32, keys & _LOW
    seed = np.uint64(zlib.crc32(lang.encode()))

    def partition(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mixed = (hashes[a] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[b]) * np.uint64(0xC2B2AE3D27D4EB4F) + seed
        return ((mixed >> np.uint64(20)) % np.uint64(partitions)).astype("int64")

    opens = np.r_[True, np.diff(first) != 0]
    single, total = first[opens], np.add.reduceat(counts, np.flatnonzero(opens))
    phrase = second > 0  # a word by itself is in its total
    first, second, third, counts = first[phrase], second[phrase], third[phrase], counts[phrase]
    of_phrase, of_word = partition(first, second), partition(single, np.zeros_like(single))
    used = np.zeros(len(words), bool)
    used[0] = True  # no word
    for part in (single, second, third):
        used[part] = True
    place_of = np.cumsum(used) - 1  # words that occur here, in the order of their numbers
    known = pa.array([words[i] for i in np.flatnonzero(used).tolist()], pa.binary())
    rank = np.empty(len(known), "int64")
    rank[pc.array_sort_indices(known).to_numpy()] = np.arange(len(known))
    single, first, second, third = (place_of[p] for p in (single, first, second, third))
    codec = pa.Codec("zstd")
    for place, parts, n in ((of_phrase, (first, second, third), counts), (of_word, (single,), total)):
        by = np.lexsort((*[rank[p] for p in reversed(parts)], place))
        place = place[by]
        names = [known.take(pa.array(p[by])) for p in parts]
        times = pa.array(n[by]).cast(pa.string()).cast(pa.binary())
        phrases = pc.binary_join_element_wise(*names, b" ") if len(names) > 1 else names[0]
        lines = pc.binary_join_element_wise(pc.binary_join_element_wise(phrases, times, b"\t"), b"", b"\n")
        if not len(lines):
            continue
        offsets = np.frombuffer(lines.buffers()[1], "i4")[lines.offset : lines.offset + len(lines) + 1]
        data = lines.buffers()[2]
        bounds = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
        for start, stop in zip(bounds, bounds[1:]):
            a, b = int(offsets[start]), int(offsets[stop])
            yield int(place[start]), lang, b - a, codec.compress(data.slice(a, b - a), asbytes=True)


def _spilled(batches: Iterable[pa.RecordBatch], partitions: int, most: int) -> Iterator[pa.RecordBatch]:
    tries: dict[str, HatTrie] = defaultdict(HatTrie)
    numbers: dict[bytes, int] = {}
    words: list[bytes] = []
    hashes = np.zeros(0, np.uint64)

    def restart():
        nonlocal numbers, words, hashes
        numbers = defaultdict(count().__next__)
        numbers[b"\n"]  # the sign between pieces is number 0
        words, hashes = [b""], np.array([zlib.crc32(b"")], np.uint64)

    def rows(share: float) -> Iterator[pa.RecordBatch]:
        nonlocal hashes
        new = list(islice(numbers, len(words), None))
        words.extend(new)
        hashes = np.append(hashes, np.fromiter(map(zlib.crc32, new), np.uint64, len(new)))
        part, size = [], 0
        for lang, trie in tries.items():
            for row in _sorted_runs(trie, trie.largest(share), lang, words, hashes, partitions):
                part.append(row)
                size += len(row[3])
                if size > 8 << 20 or len(part) >= 4096:
                    yield _run_batch(part)
                    part, size = [], 0
        if part:
            yield _run_batch(part)

    restart()
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            waiting: dict[str, list[bytes]] = defaultdict(list)
            for lang, text in zip(batch.column(0).slice(start, 512).to_pylist(), as_bytes(batch.column(1).slice(start, 512))):
                marked = text.lower().translate(_PIECES).replace(b"\n", b" \n \n ")
                waiting[lang] += filter(None, marked.split(b" "))
                waiting[lang] += (b"\n", b"\n")
            for lang, tokens in waiting.items():
                for at in range(0, len(tokens), MOST_TOKENS):  # what follows a word may lie in the next part
                    part = tokens[at : at + MOST_TOKENS + 2]
                    tries[lang].add(np.fromiter(map(numbers.__getitem__, part), "int64", len(part)))
                    if len(numbers) > MOST_WORDS:
                        yield from rows(1.0)
                        restart()
                    elif sum(t.entries for t in tries.values()) > most:
                        yield from rows(0.75)
    yield from rows(1.0)


def _run_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["partition", "lang", "size", "run"])


def _merged(table: pa.Table, least: int) -> pa.Table:
    """Phrases of a prefix partition that occur ``least`` times or more, and (as phrases of no word) its words per language."""
    out: tuple[list, list, list, list] = ([], [], [], [])

    def put(lang, phrase, words, times):
        for column, value in zip(out, (lang, phrase, words, times)):
            column.append(value)

    codec = pa.Codec("zstd")
    langs, sizes, runs = (table.column(c) for c in ("lang", "size", "run"))
    by_lang: dict[str, list[int]] = {}
    for i, lang in enumerate(langs.to_pylist()):
        by_lang.setdefault(lang, []).append(i)
    for lang, places in by_lang.items():
        lines: list[bytes] = []
        for i in places:
            lines += codec.decompress(runs[i].as_buffer(), sizes[i].as_py(), asbytes=True).split(b"\n")[:-1]
        lines.sort()  # merges the runs, which are sorted already
        everything, pair, in_pair, key, times = 0, b"", 0, b"", 0
        for line in [*lines, b" \t0"]:  # the last line closes the last groups
            found, _, n = line.rpartition(b"\t")
            if found == key:
                times += int(n)
                continue
            if times:
                words = key.count(b" ")  # a line for phrases has two spaces, for a word by itself none
                if not words:
                    everything += times
                    if times >= least:
                        put(lang, key, 1, times)
                else:
                    if not key.endswith(b" ") and times >= least:
                        put(lang, key, 3, times)
                    prefix = key[: key.rindex(b" ")]
                    if prefix != pair:
                        if in_pair >= least:
                            put(lang, pair, 2, in_pair)
                        pair, in_pair = prefix, 0
                    in_pair += times
            key, times = found, int(n)
        if in_pair >= least:
            put(lang, pair, 2, in_pair)
        if everything:
            put(lang, b"", 0, everything)
    lang, phrase, words, times = out
    return pa.table({
        "lang": pa.array(lang, pa.string()), "phrase": pa.array(phrase, pa.binary()).cast(pa.string()),
        "words": pa.array(words, pa.int32()), "count": pa.array(times, pa.int64()),
    })


def phrase_counts(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST_COUNT, most: int = MOST_ENTRIES) -> DataFrame:
    """(lang, phrase, words, count) of all phrases of 1 to 3 words that occur ``least`` times or more in their language.

    Rows with ``words`` = 0 add up to the number of all words of a language.
    """
    ship_package(df.sparkSession)
    rows = only(df, lang, text).toDF("lang", "text").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = 1 + total // PARTITION_BYTES
    runs = rows.mapInArrow(lambda b: _spilled(b, partitions, most), "partition int, lang string, size long, run binary")
    return runs.groupBy("partition").applyInArrow(lambda t: _merged(t, least), "lang string, phrase string, words int, count long")


def _score(a: Column, first: Column, rest: Column) -> Column:
    """floor(1000000 a a / (first rest)), exact."""
    a, first, rest = (c.cast("decimal(15,0)") for c in (a, first, rest))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), first * rest).cast("long")


def collocations(
    df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST_COUNT, top: int = TOP, covered: int = COVERED,
    most: int = MOST_ENTRIES,
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r (counts of the phrase and its parts), n, score."""
    counts = written(phrase_counts(df, text, lang, least, most), "phrases")
    known = counts.where("words > 0").select("lang", F.col("phrase").alias("_p"), F.col("count").alias("_c"))

    def with_count(rows: DataFrame, phrase: Column, name: str) -> DataFrame:
        """Parts of a candidate occur as often as it does at least, so they are all known."""
        keyed = rows.withColumn("_k", phrase).join(known.withColumnRenamed("lang", "_l"), (F.col("lang") == F.col("_l")) & (F.col("_k") == F.col("_p")))
        return keyed.drop("_k", "_l", "_p").withColumnRenamed("_c", name)

    word = [F.get(F.split("phrase", " "), F.lit(i)) for i in range(3)]
    both = lambda i: F.concat_ws(" ", word[i], word[i + 1])
    pairs = counts.where("words = 2").select("lang", "phrase", F.col("count").alias("a"))
    triples = counts.where("words = 3").select("lang", "phrase", F.col("count").alias("a"))

    holders = triples.select("lang", F.explode(F.array(both(0), both(1))).alias("phrase"), "a")
    holders = holders.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    pairs = pairs.join(holders, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    pairs = with_count(with_count(pairs.drop("longer"), word[0], "l"), word[1], "r")
    pairs = pairs.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))

    for phrase, name in ((word[0], "l1"), (both(1), "r1"), (both(0), "l2"), (word[2], "r2")):
        triples = with_count(triples, phrase, name)
    cuts = [F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)]
    triples = triples.withColumn("cut", F.least(*cuts))
    triples = triples.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    scored = pairs.select(triples.columns).unionByName(triples).withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*best))).where(F.col("rank") <= top)
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    totals = counts.where("words = 0").groupBy("lang").agg(F.sum("count").alias("n"))
    return scored.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
