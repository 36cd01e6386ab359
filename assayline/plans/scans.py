"""One pass over the rows that adds up dense statistics for many models at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_FEATURES = 4096
BLOCK_BYTES = 8 << 20


def feature_array(features: Sequence[str] | str) -> Column:
    """Features as one ``array<double>``: a list of columns, or one array column."""
    if isinstance(features, str):
        return F.col(features).cast("array<double>")
    return F.array(*[F.col(f"`{c}`").cast("double") for c in features])


def is_complete(features: Sequence[str] | str) -> Column:
    """True for rows without a missing feature (null or NaN); on columns the null test reaches the file scan."""
    if isinstance(features, str):
        missing = F.exists(features, lambda e: e.isNull() | F.isnan(e.cast("double")))
        return F.col(features).isNotNull() & (F.size(features) > 0) & ~missing
    known = [F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double")) for c in features]
    return reduce(lambda a, b: a & b, known)


def feature_names(df: DataFrame, features: Sequence[str] | str) -> list[str]:
    """Names of the features; elements of an array column are ``{column}_{position}``."""
    if not isinstance(features, str):
        return list(features)
    first = df.where(F.col(features).isNotNull()).select(F.size(features)).first()
    width = first[0] if first else 0
    if not 0 < width <= MAX_FEATURES:
        raise ValueError(f"feature width {width} is not in 1..{MAX_FEATURES}")
    return [f"{features}_{i}" for i in range(width)]


def to_numpy(column: pa.Array) -> np.ndarray:
    """A numeric Arrow column as a vector, or a list column of equal lengths as a matrix."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        flat = column.flatten()
        if column.null_count or flat.null_count:
            raise ValueError("feature arrays must not hold nulls")
        values = flat.to_numpy(zero_copy_only=False)
        if len(np.unique(np.diff(column.offsets.to_numpy()))) > 1:
            raise ValueError("feature arrays differ in length")
        return values.reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


Batch = Mapping[str, np.ndarray]
Statistic = Callable[[Batch], Mapping[str, np.ndarray]]


#: Partial sums of one task are rows of at most so many doubles; so many tasks' sums are added up at a time.
CHUNK, FAN_IN = 1 << 17, 64
_SUMS = "model string, part int, task int, kind string, total binary"
_NAMES = [c.split()[0] for c in _SUMS.split(", ")]


def _emitted(rows: list[tuple[str, int, int, np.ndarray]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary())
    narrow = [(m, p, t, *_narrowed(values)) for m, p, t, values in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*narrow), kinds)], names=_NAMES)


def _narrowed(values: np.ndarray) -> tuple[str, bytes]:
    """Kind of numbers and their bytes: counts take two or four bytes each if they fit."""
    low, high = values.min(initial=0), values.max(initial=0)
    if low >= 0 and high < 1 << 32 and (values == np.floor(values)).all():
        kind = "u2" if high < 1 << 16 else "u4"
        return kind, values.astype(kind).tobytes()
    return "f8", values.tobytes()


def _doubles(kind: str, total: pa.Scalar) -> np.ndarray:
    return np.frombuffer(total.as_buffer(), dtype=kind).astype("f8", copy=False)


def _task_sums(batches: Iterable[Batch], statistic: Statistic) -> Iterator[pa.RecordBatch]:
    """Add up the statistics of one task's batches and emit them once, as buffers of numbers."""
    sums: dict[str, np.ndarray] = {}
    for columns in batches:
        for model, values in statistic(columns).items():
            flat = np.asarray(values, dtype=float).ravel()
            if model in sums:
                sums[model] += flat
            else:
                sums[model] = flat.copy()
    task = TaskContext.get().partitionId()
    parts = [(m, i, task, f[s : s + CHUNK]) for m, f in sums.items() for i, s in enumerate(range(0, len(f), CHUNK))]
    step = max(1, (8 << 20) // max([1, *(p[3].nbytes for p in parts)]))
    for start in range(0, len(parts), step):
        yield _emitted(parts[start : start + step])


def _totals(table: pa.Table) -> dict[tuple[str, int], np.ndarray]:
    """The sums per model and part, added up in the order of the tasks."""
    totals: dict[tuple[str, int], np.ndarray] = {}
    for batch in table.sort_by("task").to_batches():
        names = (batch.column(c).to_pylist() for c in ("model", "part", "kind"))
        for model, part, kind, total in zip(*names, batch.column("total")):
            values = _doubles(kind, total)
            if (model, part) in totals:
                totals[model, part] += values
            else:
                totals[model, part] = values.copy()
    return totals


def _adder(groups: int) -> Callable[[pa.Table], pa.Table]:
    """One row instead of the partial sums of some tasks, which become one of ``groups``."""

    def added(table: pa.Table) -> pa.Table:
        task = table.column("task")[0].as_py() % groups
        return pa.Table.from_batches([_emitted([(model, part, task, total) for (model, part), total in _totals(table).items()])])

    return added


def _merged(emitted: DataFrame, tasks: int = FAN_IN * FAN_IN) -> DataFrame:
    """One row per model and chunk, whatever the number of ``tasks``: what reaches the driver does not grow with them."""
    emitted = _fewer(emitted, tasks)
    return emitted.groupBy("model", "part").applyInArrow(_adder(1), _SUMS)


def _fewer(emitted: DataFrame, tasks: int) -> DataFrame:
    """Partial sums of at most about ``FAN_IN`` groups of tasks."""
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        emitted = emitted.groupBy("model", "part", F.pmod("task", F.lit(tasks))).applyInArrow(_adder(tasks), _SUMS)
    return emitted


def sum_over_rows(df: DataFrame, statistic: Statistic) -> DataFrame:
    """Sum the arrays that ``statistic`` returns per batch, as partial sums for :func:`collect_sums` or :func:`long_sums`.

    Each task adds its batches up locally and emits one buffer per model and chunk; these
    are merged in two levels, so what is shuffled is tasks x models buffers and what is left one of each.
    """

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = (b for b in batches if b.num_rows)
        columns = ({n: to_numpy(b.column(i)) for i, n in enumerate(b.schema.names)} for b in filled)
        yield from _task_sums(columns, statistic)

    return _merged(df.mapInArrow(per_task, _SUMS))


def _unpacked(batches: Iterable[pa.RecordBatch], kinds: dict[str, tuple[str, bool]]) -> Iterator[tuple[Batch, pa.RecordBatch]]:
    """A block at a time, read where Arrow holds it, and its row."""
    for batch in batches:
        for i in range(batch.num_rows):
            n, out = batch.column("n")[i].as_py(), {}
            for name, (kind, is_matrix) in kinds.items():
                values = np.frombuffer(batch.column(name)[i].as_buffer(), dtype=kind)
                out[name] = values.reshape(n, -1) if is_matrix else values
            yield out, batch.slice(i, 1)


@dataclass(frozen=True)
class PackedRows:
    """Rows kept as dense blocks of numbers, for algorithms that scan the same rows many times."""

    blocks: DataFrame
    kinds: dict[str, tuple[str, bool]]

    def sum(self, statistic: Statistic) -> DataFrame:
        """The sums of :func:`sum_over_rows`, without converting the rows again."""
        return _merged(self.partial_sums(statistic), self.tasks)

    def totals(self, statistic: Statistic) -> dict[str, np.ndarray]:
        """These sums on the driver."""
        return collect_sums(self.sum(statistic))

    def reduce(self, statistic: Statistic, finish: Callable[[str, np.ndarray], np.ndarray]) -> dict[str, np.ndarray]:
        """``finish(model, sums)`` of every model, where the sums are added up; only what it returns reaches the driver."""

        def finished(table: pa.Table) -> pa.Table:
            found = _joined(_totals(table))
            return pa.Table.from_batches([_emitted([(m, 0, 0, np.asarray(finish(m, sums), dtype=float).ravel()) for m, sums in found.items()])])

        emitted = _fewer(self.partial_sums(statistic), self.tasks)
        return collect_sums(emitted.groupBy("model").applyInArrow(finished, _SUMS))

    def median(self, values: Callable[[Batch], np.ndarray]) -> float:
        """The exact median of one number per row, which ``values`` makes of a block: null for no rows.

        Numbers are ordered as 64-bit integers and the middle ranks found digit by digit, 16 bits in a scan; counts
        of digits are added up and searched in the tasks, so five numbers a scan reach the driver.
        """
        prefixes: dict[str, tuple[int, int | None]] = {"low": (0, None), "high": (0, None)}  # digits so far, rank below them
        for shift in (48, 32, 16, 0):
            wanted = sorted({p for p, _ in prefixes.values()})

            def counted(batch, shift=shift, wanted=tuple(wanted)):
                bits = np.asarray(values(batch), "f8").view("u8")
                bits = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))
                digit = ((bits >> np.uint64(shift)) & np.uint64(0xFFFF)).astype("int64")
                above = bits >> np.uint64(shift + 16) if shift < 48 else np.zeros(len(bits), "u8")
                return {str(p): np.bincount(digit[above == np.uint64(p)], minlength=1 << 16) for p in wanted}

            def searched(model, counts, prefixes=prefixes):
                upto = np.cumsum(counts)
                n, out = int(upto[-1]), [upto[-1]]
                for (prefix, rank), middle in zip(prefixes.values(), ((n - 1) // 2, n // 2)):
                    rank = middle if rank is None else rank
                    digit = min(int(np.searchsorted(upto, rank, side="right")), len(upto) - 1)
                    out += [digit, rank - (upto[digit - 1] if digit else 0)] if str(prefix) == model and n else [0, 0]
                return np.array(out)

            found = self.reduce(counted, searched)
            if shift == 48 and not found.get("0", np.zeros(1))[0]:
                return float("nan")
            prefixes = {
                name: (prefix << 16 | int(found[str(prefix)][1 + 2 * i]), int(found[str(prefix)][2 + 2 * i]))
                for i, (name, (prefix, _)) in enumerate(prefixes.items())
            }
        bits = np.array([p for p, _ in prefixes.values()], "u8")
        bits = np.where(bits >> np.uint64(63), bits & np.uint64((1 << 63) - 1), ~bits)
        return float(bits.view("f8").mean())

    @property
    def tasks(self) -> int:
        """Tasks of a scan at most: one for every core, as each brings sums of its own."""
        return max(1, self.blocks.sparkSession.sparkContext.defaultParallelism)

    def partial_sums(self, statistic: Statistic) -> DataFrame:
        kinds = self.kinds
        return self.blocks.coalesce(self.tasks).mapInArrow(lambda batches: _task_sums((b for b, _ in _unpacked(batches, kinds)), statistic), _SUMS)

    def with_column(self, name: str, make: Callable[[Batch], np.ndarray]) -> PackedRows:
        """These blocks and one more column (or another one of that name) of doubles; kept in the cache like these."""
        kinds = {k: v for k, v in self.kinds.items() if k != name}
        names = ["n", *kinds]

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, row in _unpacked(batches, kinds):
                values = np.ascontiguousarray(make(batch), dtype="f8")
                columns = [row.column(c) for c in names] + [pa.array([values.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, name])

        schema = "n int, " + ", ".join(f"`{n}` binary" for n in [*kinds, name])
        blocks = self.blocks.select(*names).mapInArrow(added, schema).persist()
        return PackedRows(blocks, {**kinds, name: ("f8", False)})

    def unpersist(self) -> None:
        self.blocks.unpersist()


def pack_rows(df: DataFrame, narrow: Mapping[str, str] | None = None) -> PackedRows:
    """Pack numeric and array columns into blocks of at most about ``BLOCK_BYTES`` and keep them in Spark's cache.

    ``narrow`` names smaller kinds of numbers that columns fit into.
    """
    numbers = {"double": "f8", "bigint": "i8", "int": "i4"}
    kinds = {
        f.name: ("f8", True) if isinstance(f.dataType, T.ArrayType) else (numbers[f.dataType.simpleString()], False)
        for f in df.schema.fields
    }
    kinds |= {n: (kind, kinds[n][1]) for n, kind in (narrow or {}).items()}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n", *kinds]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = {
                n: np.ascontiguousarray(to_numpy(batch.column(i)), dtype=kinds[n][0]) for i, n in enumerate(kinds)
            }
            per_row = sum(c.nbytes for c in columns.values()) / batch.num_rows
            step = max(1, int(BLOCK_BYTES / max(per_row, 1)))
            for start in range(0, batch.num_rows, step):
                parts = [c[start:start + step] for c in columns.values()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(parts[0])], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], names=names
                )

    schema = "n int, " + ", ".join(f"`{n}` binary" for n in kinds)
    return PackedRows(df.mapInArrow(pack, schema).persist(), kinds)


#: Rows that a shift is taken from.
SHIFT_ROWS = 1024


def means_of(rows: DataFrame, *columns: str) -> np.ndarray:
    """Means of numeric and array columns, one after the other, over a few rows: a shift against lost digits, not a statistic."""
    found = rows.select(*columns).limit(SHIFT_ROWS).toArrow()
    if not found.num_rows:
        raise ValueError("no complete rows")
    return np.concatenate([np.atleast_1d(to_numpy(found.column(c).combine_chunks()).mean(axis=0)) for c in columns])


def collect_sums(sums: DataFrame) -> dict[str, np.ndarray]:
    """Bring summed statistics (models x statistic length) to the driver."""
    return _assembled(sums.toArrow())


def _assembled(sums: pa.Table) -> dict[str, np.ndarray]:
    return _joined(_totals(sums))


def _joined(totals: Mapping[tuple[str, int], np.ndarray]) -> dict[str, np.ndarray]:
    found: dict[str, dict[int, np.ndarray]] = {}
    for (model, part), values in totals.items():
        found.setdefault(model, {})[part] = values
    return {model: np.concatenate([parts[i] for i in range(len(parts))]) for model, parts in found.items()}


def long_sums(sums: DataFrame) -> DataFrame:
    """Summed statistics as a table (model, idx, value)."""

    def spread(table: pa.Table) -> pa.Table:
        (total,) = _totals(table).values()
        place = table.column("part")[0].as_py() * CHUNK + np.arange(len(total), dtype=np.int32)
        return pa.table({"model": pa.array([table.column("model")[0].as_py()] * len(total), pa.string()), "idx": place.astype(np.int32), "value": total})

    return sums.groupBy("model", "part").applyInArrow(spread, "model string, idx int, value double")


def map_rows(
    df: DataFrame,
    keep: Sequence[str],
    inputs: Sequence[str],
    fn: Callable[[Batch], Mapping[str, np.ndarray]],
    added: str,
) -> DataFrame:
    """Keep the columns ``keep`` and add columns computed from ``inputs`` with NumPy, batch by batch."""
    new = T.StructType.fromDDL(added)
    schema = T.StructType([df.schema[c] for c in keep] + list(new.fields))
    wanted = list(dict.fromkeys([*keep, *inputs]))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            result = fn({c: to_numpy(batch.column(wanted.index(c))) for c in inputs})
            arrays = [batch.column(wanted.index(c)) for c in keep]
            arrays += [_to_arrow(np.asarray(result[f.name]), f.dataType) for f in new.fields]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(*wanted).mapInArrow(per_task, schema)


def _to_arrow(values: np.ndarray, kind: T.DataType) -> pa.Array:
    if isinstance(kind, T.ArrayType):
        width = values.shape[1]
        flat = pa.array(np.ascontiguousarray(values, dtype=float).ravel())
        offsets = pa.array(np.arange(0, (len(values) + 1) * width, width, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, flat)
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.array(values).cast(arrow[kind.simpleString()])
