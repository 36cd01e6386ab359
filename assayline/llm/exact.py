"""Exact duplicates by counting quotient filters.

Method: every partition counts the 64-bit fingerprints of its normalised texts in counting quotient filters,
one per block of quotients.  The filters of a block merge losslessly: their runs are decoded, merged by sorted
remainder, and counts added.  Fingerprints counted more than once route their rows to byte verification,
where rows are grouped by the normalised bytes themselves; all other rows are single.

Texts are equal when identical after lower-casing A-Z only; null counts as empty.  Of equal texts the row with the
largest id stays.  Ties: rows that repeat this id as well all stay, as nothing tells them apart.  Rows
without an id stay only where no equal text has one.  Very long texts are read whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.llm.common import as_bytes, map_batches, only, written
from assayline.plans.joins import split_join

#: Fingerprints per block of quotients, about; and fingerprints a task counts before it writes its filters.
BLOCK_ROWS, TASK_ROWS = 1 << 15, 1 << 20
#: Bits of the map that keeps single rows away from the verification; 2 MB at most, whatever the corpus.
#: A fuller map lets more single rows through, which changes no result.
MAP_BITS = 24


class QuotientFilter:
    """Counts of fingerprints below 2**bits: quotient (high bits) by its slot, remainders sorted within a run."""

    def __init__(self, bits: int, quotient_bits: int, occupied: bytes, ends: bytes, remainders: bytes, counts: bytes):
        self.bits, self.quotient_bits = bits, quotient_bits
        self.occupied, self.ends, self.remainders, self.counts = occupied, ends, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray, bits: int, quotient_bits: int) -> QuotientFilter:
        """From sorted distinct fingerprints (unsigned 64-bit) and their counts."""
        low = np.uint64(bits - quotient_bits)
        quotients = (fingerprints >> low).astype("int64")
        occupied = np.zeros(1 << quotient_bits, bool)
        occupied[quotients] = True
        ends = np.append(quotients[1:] != quotients[:-1], True) if len(quotients) else np.zeros(0, bool)
        remainders = fingerprints & ((np.uint64(1) << low) - np.uint64(1))
        return cls(
            bits, quotient_bits, np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(),
            remainders.astype("<u8").tobytes(), counts.astype("<u8").tobytes(),
        )

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints and their counts."""
        remainders = np.frombuffer(self.remainders, "<u8")
        ends = np.unpackbits(np.frombuffer(self.ends, np.uint8))[: len(remainders)].astype("int64")
        runs = np.cumsum(ends) - ends
        slots = np.flatnonzero(np.unpackbits(np.frombuffer(self.occupied, np.uint8)))
        quotients = slots[runs].astype(np.uint64) if len(remainders) else np.zeros(0, np.uint64)
        return quotients << np.uint64(self.bits - self.quotient_bits) | remainders, np.frombuffer(self.counts, "<u8")


def counted(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints, sorted, with the sums of their counts."""
    distinct, place = np.unique(fingerprints, return_inverse=True)
    sums = np.zeros(len(distinct), "uint64")
    np.add.at(sums, place, counts.astype("uint64"))
    return distinct, sums


def merged(filters: list[QuotientFilter]) -> QuotientFilter:
    """One filter with the counts of all; nothing is lost, whatever the order."""
    items = [f.items() for f in filters]
    fingerprints, counts = counted(np.concatenate([k for k, _ in items]), np.concatenate([c for _, c in items]))
    return QuotientFilter.of(fingerprints, counts, filters[0].bits, filters[0].quotient_bits)


FILTERS = "block int, occupied binary, ends binary, remainders binary, counts binary"


def _filter_schema() -> pa.Schema:
    return pa.schema([("block", pa.int32())] + [(c, pa.binary()) for c in ("occupied", "ends", "remainders", "counts")])


def partition_filters(prints: DataFrame, block_bits: int, quotient_bits: int) -> DataFrame:
    """Counting quotient filters of the ``fp`` values of each partition, one row per block of quotients."""
    bits = 64 - block_bits

    def filters(values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(values).view(np.uint64)
        distinct, counts = counted(every, np.ones(len(every), "uint64"))
        # Shifting by 64 is undefined, so the only block of a small input is named without it.
        blocks = (distinct >> np.uint64(bits)).astype("int32") if block_bits else np.zeros(len(distinct), "int32")
        inner = distinct & np.uint64((1 << bits) - 1)
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        for keys, numbers, block in zip(np.split(inner, cuts), np.split(counts, cuts), np.split(blocks, cuts)):
            f = QuotientFilter.of(keys, numbers, bits, quotient_bits)
            row = [[int(block[0])], [f.occupied], [f.ends], [f.remainders], [f.counts]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(row, _filter_schema())], schema=_filter_schema())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, rows = [], 0
        for batch in batches:
            values.append(batch.column(0).to_numpy().astype("int64"))
            rows += batch.num_rows
            if rows >= TASK_ROWS:
                yield from filters(values)
                values, rows = [], 0
        if rows:
            yield from filters(values)

    return prints.select("fp").mapInArrow(run, FILTERS)


def repeated_fingerprints(prints: DataFrame) -> DataFrame:
    """Values of ``fp`` that occur more than once, as merged counting quotient filters say."""
    rows = prints.count()
    block_bits = max(0, (rows // BLOCK_ROWS).bit_length())
    bits, quotient_bits = 64 - block_bits, min(15, max(1, (rows >> block_bits).bit_length()))

    def merge(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in ("occupied", "ends", "remainders", "counts")]
        keys, counts = merged([QuotientFilter(bits, quotient_bits, *parts) for parts in zip(*columns)]).items()
        high = np.uint64(table.column("block")[0].as_py() << bits) if block_bits else np.uint64(0)
        return pa.table({"fp": (keys[counts > 1] | high).view("int64")})

    return partition_filters(prints, block_bits, quotient_bits).groupBy("block").applyInArrow(merge, "fp long")


def _fingerprints(texts: list[bytes], bits: int) -> np.ndarray:
    """Leading ``bits`` bits of XXH64, the others zero."""
    high = ~((1 << 64 - bits) - 1) & (1 << 64) - 1
    return np.array([xxhash.xxh64_intdigest(x) & high for x in texts], np.uint64)


def prints(df: DataFrame, text: str, key: str, bits: int = 64) -> DataFrame:
    """Key, fingerprint and SHA-256 of the normalised text."""

    def make():
        def step(batch: pa.RecordBatch):
            texts = [x.lower() for x in as_bytes(batch.column(1))]  # on bytes: A-Z only
            return [batch.column(0), pa.array(_fingerprints(texts, bits).view("int64")), [hashlib.sha256(x).hexdigest() for x in texts]]

        return step

    fields = [*only(df, key).schema.fields, T.StructField("fp", T.LongType()), T.StructField("text_sha256", T.StringType())]
    return map_batches(only(df, key, text), T.StructType(fields), make)


def _routed(df: DataFrame, text: str, key: str, repeated: DataFrame, print_bits: int) -> DataFrame:
    """Rows whose fingerprint may be repeated, with their normalised bytes.

    The repeated fingerprints reach the tasks as a map of 2**MAP_BITS bits, put together in Spark.
    """
    spot = F.shiftrightunsigned("fp", 64 - MAP_BITS)
    words = repeated.groupBy(F.shiftright(spot, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {64 - MAP_BITS}) & 63 as int))")).alias("bits")
    )
    rows = words.toPandas()  # at most 2**(MAP_BITS - 6) rows
    packed = np.zeros(1 << (MAP_BITS - 6), "int64")
    packed[rows["word"].to_numpy("int64")] = rows["bits"].to_numpy("int64")
    shared = df.sparkSession.sparkContext.broadcast(packed.view(np.uint64))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = [x.lower() for x in as_bytes(batch.column(1))]
                fps = _fingerprints(texts, print_bits)
                at = fps >> np.uint64(64 - MAP_BITS)
                hit = (bits[(at >> np.uint64(6)).astype("int64")] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
                taken = pa.array(hit)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).filter(taken), pa.array(fps.view("int64")).filter(taken),
                     pa.array([t for t, h in zip(texts, hit) if h], pa.binary())], names=["key", "fp", "normal"]
                )

    kind = only(df, key).schema.fields[0].dataType.simpleString()
    return only(df, key, text).mapInArrow(run, f"key {kind}, fp long, normal binary")


def exact_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", bits: int = 64) -> DataFrame:
    """Per row of ``df``: key, keep_id, group_size, kept, text_sha256.

    Fewer ``bits`` of fingerprint send more rows to the verification and give the same result.
    """
    base = written(prints(df, text, key, bits), "prints")
    repeated = written(repeated_fingerprints(base), "repeated")
    groups = (
        _routed(df, text, key, repeated, bits)
        .groupBy("fp", "normal")
        .agg(F.max("key").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select("fp", F.sha2("normal", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    out = split_join(base, written(groups, "groups"), ["fp", "text_sha256"], "left")
    keep = F.coalesce("keep_id", F.col(f"`{key}`"))
    return out.select(
        F.col(f"`{key}`"), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        keep.eqNullSafe(F.col(f"`{key}`")).alias("kept"), "text_sha256",
    )
