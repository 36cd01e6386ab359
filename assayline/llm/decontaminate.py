"""Documents that hold passages of a benchmark.

Method: a prefix-filtered set join with exact containment.  An item's windows are its runs of ten words (an item
of fewer is one window).  All words of a window must be in a matching document, so the prefix to join on is one
word: the window's rarest, counted over all documents.  A document's word at position p that is the prefix
word at offset o of a window of n words leaves one place for it, p - o; it must lie inside the document (length and
position bounds), and the words there are compared with the window.

The benchmark is a stated set of queries: it is cut into blocks of bounded size, and each block is broadcast
and meets every document once; what several blocks find is put together in the row, without a shuffle.

Cases: null or empty texts have no words and are clean; items without words have no windows; equal
items are all named; items without an id are left out, or with ``unnamed`` hit like any other and are null in ``item_ids``.  Very long documents are read whole.  Repeated rows get the same result each.
Empty tables of documents give empty results, an empty benchmark hits nothing, and other columns of documents may have any name.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.llm.common import as_bytes, map_batches, only

WINDOW_WORDS = 10
#: Bytes of benchmark text per block.
BLOCK_BYTES = 16 << 20

#: Lower-cases A-Z and turns every ASCII character that is neither letter nor digit into a space.
_WORDS = bytes(
    b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of ASCII letters and digits and of anything that is not ASCII."""
    return text.translate(_WORDS).split()


def windows_of(words: list[bytes], size: int = WINDOW_WORDS) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def _counts(docs: DataFrame, text: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Occurrences, over all documents, of the words of one block of the benchmark."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = shared.value, Counter()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for x in as_bytes(batch.column(0).slice(start, 256)):
                    total.update(filter(known.__contains__, words_of(x)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"]
        )

    found = only(docs, text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in found.collect()}  # no more rows than the block has words


def in_order(names: set[str | None]) -> list[str | None]:
    """Names in order, after the null of items without one."""
    return sorted(names, key=lambda name: (name is not None, name or ""))


class Block:
    """Windows of one block of items by their rarest word."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], counts: dict[bytes, int], size: int) -> None:
        owners: dict[tuple[bytes, ...], set[str | None]] = defaultdict(set)
        for item, words in items:
            for window in windows_of(words, size):
                owners[window].add(item)
        self.owners = {window: in_order(names) for window, names in owners.items()}
        self.places: dict[bytes, set[tuple[int, int]]] = defaultdict(set)
        for window in owners:
            offset = min(range(len(window)), key=lambda i: (counts.get(window[i], 0), window[i], i))
            self.places[window[offset]].add((offset, len(window)))
        self.places = {word: sorted(places) for word, places in self.places.items()}

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Stretches of words inside occurrences of windows, and the items they belong to."""
        stretches, items, places, owners = [], set(), self.places, self.owners
        for position in [i for i, word in enumerate(words) if word in places]:
            for offset, length in places[words[position]]:
                start = position - offset
                if start >= 0 and start + length <= len(words):
                    found = owners.get(tuple(words[start : start + length]))
                    if found:
                        stretches.append((start, start + length))
                        items.update(found)
        return stretches, items


def joined(stretches: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same words as disjoint stretches in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(stretches):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _found(prefix: str) -> list[T.StructField]:
    numbers = T.ArrayType(T.IntegerType())
    kinds = {"n_words": T.LongType(), "starts": numbers, "ends": numbers, "item_ids": T.ArrayType(T.StringType())}
    return [T.StructField(prefix + name, kind) for name, kind in kinds.items()]


def contained(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
    item: str = "item_id", item_text: str = "text", size: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES, prefix: str = "",
    unnamed: bool = False,
) -> DataFrame:
    """Columns ``keep``, ``n_words``, hit stretches (``starts``, ``ends``: word positions, end exclusive), ``item_ids``.

    ``prefix`` goes before the names of the new columns; ``unnamed`` takes items without an id as well.
    """
    items = benchmark.select(
        F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{item_text}`").alias("text")
    ).where("text is not null" if unnamed else "item is not null and text is not null")
    n_blocks = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes
    found = None
    for number in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == number)
        rows = [(r["item"], words_of(r["text"].encode())) for r in block.collect()]  # about block_bytes
        counts = _counts(docs, text, {word for _, words in rows for word in words})
        found = _step(
            docs if found is None else found, Block(rows, counts, size), text, keep, prefix, found is not None, number == n_blocks - 1
        )
    return found


def _step(df: DataFrame, block: Block, text: str, keep: tuple[str, ...], prefix: str, further: bool, last: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(block)
    carried_text = f"{prefix}carried_text"
    names = [*keep, *((carried_text, prefix + "starts", prefix + "ends", prefix + "item_ids") if further else (text,))]
    source = only(df, *names)

    def make():
        def step(batch: pa.RecordBatch):
            block, at = shared.value, len(keep)
            n, starts, ends, items = [], [], [], []
            before = [batch.column(at + 1 + i).to_pylist() for i in range(3)] if further else None
            for i, value in enumerate(as_bytes(batch.column(at))):
                words = words_of(value)
                stretches, names = block.find(words)
                if before:
                    stretches += list(zip(before[0][i], before[1][i]))
                    names |= set(before[2][i])
                stretches = joined(stretches)
                n.append(len(words))
                starts.append([a for a, _ in stretches])
                ends.append([b for _, b in stretches])
                items.append(in_order(names))
            carried = [] if last else [batch.column(at)]
            return [*batch.columns[:at], *carried, n, starts, ends, items]

        return step

    carried = [] if last else [T.StructField(carried_text, T.StringType())]
    return map_batches(source, T.StructType([*source.schema.fields[: len(keep)], *carried, *_found(prefix)]), make)


def clean(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", unnamed: bool = False
) -> DataFrame:
    """The documents, all columns, that hold no window of the benchmark."""
    prefix = "found_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    found = contained(docs, benchmark, text, tuple(docs.columns), item, item_text, prefix=prefix, unnamed=unnamed)
    return only(found.where(F.size(prefix + "starts") == 0), *docs.columns)
