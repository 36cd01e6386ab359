"""Near-duplicate documents by SimHash fingerprints and BK-trees.

Method: the distinct fingerprints are dealt into shards by the leading bits of each of four 16-bit quarters.
Two fingerprints that differ in at most three bits agree in at least one quarter, so they meet in a shard.
A shard builds a BK-tree (children keyed by their integer Hamming distance to the parent) and looks every
fingerprint up in it, following only edges within the radius; it returns a spanning forest of its links,
never all pairs.  Shards that are still large are dealt anew by quarters of the remaining bits, which is
exact again.  The trees travel with their shard's rows and not through the driver: a broadcast of all trees
would grow with the corpus.

Cases: texts without words (null, empty, white space) have fingerprint zero and are linked like any other.
Equal fingerprints are linked; ties cannot arise, as the smallest doc_id of a component is its id.  Repeated rows
get the same result each.  Null ids take part but name no component unless nothing else is there.
Other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.llm.common import as_bytes, map_batches, only, shipped, written
from assayline.llm.links import smallest_reachable
from assayline.plans.joins import split_join

SEED = 42
RADIUS = 3
SHINGLE_WORDS = 3
#: Fingerprints that a shard should hold; those with more than four times as many are dealt anew.
SHARD_ROWS = 1024

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype("int64")


def shingle_hashes(text: bytes, words: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of every run of ``words`` words of a UTF-8 text, A-Z lower-cased; fewer words are one run."""
    parts = text.lower().split()  # on bytes: A-Z only, and splits at 0x20 and 0x09-0x0D
    if not parts:
        return []
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [digest(joined, SEED)]
    ends = list(accumulate(map(len, parts)))
    ends = [end + i for i, end in enumerate(ends)]
    starts = [0, *(end + 1 for end in ends)]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])]


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """64 bits; each is 1 if set in over half of the shingle hashes."""
    hashes = np.array(shingle_hashes(text, words), ">u8")
    if not len(hashes):
        return 0
    octets = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and the signed 64-bit ``fingerprint``."""

    def make():
        def step(batch: pa.RecordBatch):
            return [*batch.columns[: len(keep)], [fingerprint(x) for x in as_bytes(batch.column(len(keep)))]]

        return step

    fields = [*only(df, *keep).schema.fields, T.StructField("fingerprint", T.LongType())]
    return map_batches(only(df, *keep, text), T.StructType(fields), make)


class BKTree:
    """Children keyed by their Hamming distance to the parent.  Distinct unsigned 64-bit keys, in insertion order."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.child = np.full((len(keys), 65), -1, "int32")
        values, child = keys.tolist(), [{} for _ in range(len(keys))]
        for i, value in enumerate(values[1:], 1):
            node = 0
            while True:
                distance = (values[node] ^ value).bit_count()
                following = child[node].get(distance)
                if following is None:
                    child[node][distance] = i
                    self.child[node, distance] = i
                    break
                node = following

    def links(self, radius: int, rows: int = 1024) -> np.ndarray:
        """Pairs (earlier, later) of positions whose keys differ in at most ``radius`` bits.

        All lookups walk the tree together, level by level, ``rows`` at a time.
        """
        found = []
        for start in range(1, len(self.keys), rows):
            query = np.arange(start, min(start + rows, len(self.keys)), dtype="int64")
            node = np.zeros(len(query), "int64")
            while len(query):
                distance = np.bitwise_count(self.keys[query] ^ self.keys[node]).astype("int64")
                near = distance <= radius
                found.append(np.stack([node[near], query[near]], 1))
                following = []
                for shift in range(-radius, radius + 1):
                    edge = distance + shift
                    inside = (edge > 0) & (edge <= 64)
                    child = self.child[node[inside], edge[inside]]
                    owner = query[inside]
                    useful = (child >= 0) & (child < owner)  # what was inserted later looks this one up itself
                    following.append((owner[useful], child[useful].astype("int64")))
                query = np.concatenate([q for q, _ in following])
                node = np.concatenate([n for _, n in following])
        return np.concatenate(found) if found else np.zeros((0, 2), "int64")


def forest(n: int, links: np.ndarray) -> np.ndarray:
    """For each of ``n`` positions the smallest position linked to it, directly or not."""
    root = np.arange(n)
    while len(links):
        a, b = root[links[:, 0]], root[links[:, 1]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low != high
        if not apart.any():
            break
        links, low, high = links[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return root


def _shard_links(shard: pa.Table) -> pa.Table:
    keys = np.unique(shard.column("fingerprint").to_numpy()).astype("int64")
    order = np.random.default_rng(len(keys)).permutation(len(keys))  # sorted insertion would make long chains
    keys = keys[order]
    root = forest(len(keys), BKTree(keys.view(np.uint64)).links(RADIUS))
    linked = root != np.arange(len(keys))
    return pa.table({"a": pa.array(keys[linked]), "b": pa.array(keys[root[linked]])})


def _bits(start: int, width: int) -> Column:
    """Bits of the fingerprint, counted from the highest."""
    return F.shiftrightunsigned("fingerprint", 64 - start - width).bitwiseAND(F.lit((1 << width) - 1))


def _parts(free: list[tuple[int, int]], n: int) -> list[list[tuple[int, int]]]:
    """Stretches of bits (start, width) dealt into ``n`` parts of nearly equal size."""
    bits = [b for start, width in free for b in range(start, start + width)]
    cuts = [len(bits) * i // n for i in range(n + 1)]
    parts = []
    for i in range(n):
        stretches: list[tuple[int, int]] = []
        for b in bits[cuts[i] : cuts[i + 1]]:
            if stretches and sum(stretches[-1]) == b:
                stretches[-1] = (stretches[-1][0], stretches[-1][1] + 1)
            else:
                stretches.append((b, 1))
        parts.append(stretches)
    return parts


def _dealt(rows: DataFrame, free: list[tuple[int, int]], leading: int) -> list[tuple[DataFrame, list[tuple[int, int]]]]:
    """Rows once per part of the ``free`` bits, with that part in their shard; and the bits that stay free.

    ``leading``: how many leading bits of each part tell shards apart.
    """
    parts, out = _parts(free, RADIUS + 1), []
    for i, part in enumerate(parts):
        used, left = [], leading
        for start, width in part:
            if left > 0:
                used.append((start, min(width, left)))
                left -= width
        label = F.concat_ws(".", F.col("shard"), F.lit(str(i)), *[_bits(*u).cast("string") for u in used])
        rest = [s for j, other in enumerate(parts) if j != i for s in other]
        out.append((rows.withColumn("shard", label), sorted(rest)))
    return out


def links(distinct: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) that connect all of the distinct ``fingerprint`` values within the radius, directly or not."""
    ready, rows = [], distinct.select("fingerprint", F.lit("").alias("shard"))
    todo = [(rows, [(0, 64)])]
    total = distinct.count()
    for level in range(4):
        leading = max(0, (total // shard_rows).bit_length()) if level == 0 else 16
        dealt = [x for rows, free in todo for x in _dealt(rows, free, leading)]
        todo = []
        if level == 3:
            ready += [rows for rows, _ in dealt]
            break
        counts = reduce(DataFrame.unionByName, [rows for rows, _ in dealt]).groupBy("shard").count()
        large = written(counts.where(F.col("count") > 4 * shard_rows).select("shard"), "shards")
        n_large = large.count()
        if not n_large:
            ready += [rows for rows, _ in dealt]
            break
        for rows, free in dealt:
            ready.append(rows.join(large, "shard", "left_anti"))
            todo.append((rows.join(large, "shard", "left_semi"), free))
    sharded = reduce(DataFrame.unionByName, ready)
    return sharded.groupBy("shard").applyInArrow(_shard_links, "a long, b long").distinct()


def components(prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """Columns of ``prints`` and the ``component_id`` of each row: the smallest ``key`` reachable over links."""
    distinct = written(prints.groupBy("fingerprint").agg(F.min(key).alias("_first")), "fingerprints")
    roots = smallest_reachable(written(links(distinct), "links"))
    rooted = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    rooted = rooted.withColumn("_root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = split_join(rooted.select("fingerprint", "_root"), least, ["_root"]).select("fingerprint", "component_id")
    return split_join(prints, named, ["fingerprint"])


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: key, signed ``fingerprint``, ``component_id``."""
    return components(written(fingerprints(df, text, (key,)), "prints"), key)


def deduplicated(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each component, the one with the smallest key, with all its columns.

    Rows that repeat a key count as one document, which keeps one row; rows without a key all stay, as they cannot be named.
    """
    found = written(near_duplicates(df, text, key), "components")
    states = found.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("_key")).agg(
        F.max((F.col(f"`{key}`") == F.col("component_id")).cast("int")).alias("stays"), F.count("*").alias("rows")
    )
    states = written(states.where("stays = 0 or rows > 1"), "states")
    gone, several = states.where("stays = 0").select("_key"), states.where("stays = 1").select("_key")
    out = df.join(shipped(gone), df[f"`{key}`"] == F.col("_key"), "left_anti")
    if not several.limit(1).count():
        return out
    repeated = F.col(f"`{key}`").eqNullSafe(F.col("_key"))
    once = out.join(shipped(several), repeated, "left_semi").dropDuplicates([key])
    return out.join(shipped(several), repeated, "left_anti").unionByName(once)


def as_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))
