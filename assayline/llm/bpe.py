"""Byte-level BPE encoding and decoding with the files of public tokenizers.

Method: a text is split at special tokens and then into pieces; the bytes of a piece form a doubly linked
list of symbols, and a priority queue holds its mergeable neighbours by merge rank.  The lowest rank is
merged first; entries whose symbols have changed meanwhile are skipped.  Decoding concatenates the bytes
of the vocabulary's strings.

Cases: null or empty text has no tokens and decodes to the empty text.  Very long texts and very long
pieces are encoded whole; merging costs n log n for a piece of n bytes.  Repeated rows are encoded
alike.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from assayline.llm.common import as_text, kept, map_batches, only

# Fixed value: how byte-level tokenizers of this family split a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces, and words with what follows them, that a worker remembers, twice; about 200 bytes each.
CACHE_PIECES, CACHE_WORDS = 350_000, 200_000


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte: printable Latin-1 stays, the others follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Merge ranks and token bytes read from the JSON text of a byte-level BPE tokenizer."""

    def __init__(self, source: str) -> None:
        parsed = json.loads(source)
        model = parsed["model"]
        if model.get("type") != "BPE" or (parsed.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("a byte-level BPE tokenizer is needed")
        if parsed.get("normalizer") or parsed["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("normalisers and prefix spaces are not supported")
        letters, ids = byte_letters(), model["vocab"]
        self.strings: dict[int, bytes] = {
            i: bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
            for token, i in ids.items()
        }
        self.of_byte = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        #: left << 17 | right -> rank << 17 | joined
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(ids[left] << 17 | ids[right], rank << 17 | ids[left + right])
        if max(ids.values()) >= 1 << 17:
            raise ValueError("at most 131,072 tokens are supported")
        self.special: dict[str, int] = {}
        for token in parsed.get("added_tokens", []):
            if token["lstrip"] or token["rstrip"] or token["single_word"] or token["normalized"]:
                raise ValueError("added tokens with rules for their neighbourhood are not supported")
            self.special[token["content"]] = token["id"]
            self.strings[token["id"]] = token["content"].encode()

    def merge(self, piece: bytes) -> list[int]:
        """Tokens of one piece.  Entries of the queue are rank << 32 | position of the left symbol."""
        found = self.merges.get
        symbols = [self.of_byte[b] for b in piece]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            entry = found(symbols[i] << 17 | symbols[i + 1])
            if entry is not None:
                queue.append(entry >> 17 << 32 | i)
        heapify(queue)
        while queue:
            top = heappop(queue)
            i = top & 0xFFFFFFFF
            left, j = symbols[i], after[i]
            if left < 0 or j >= n:
                continue  # stale: merged into its left neighbour, or now the last symbol
            entry = found(left << 17 | symbols[j])
            if entry is None or entry >> 17 != top >> 32:
                continue  # stale: one of the two has grown meanwhile
            symbols[i] = joined = entry & 0x1FFFF
            symbols[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                entry = found(joined << 17 | symbols[k])
                if entry is not None:
                    heappush(queue, entry >> 17 << 32 | i)
            h = before[i]
            if h >= 0:
                entry = found(symbols[h] << 17 | joined)
                if entry is not None:
                    heappush(queue, entry >> 17 << 32 | h)
        return [s for s in symbols if s >= 0]


class _Remembered(dict):
    """Results of a function of a string, filled on demand, in two generations.

    When the younger is full it becomes the older, and strings that still occur come back from there.
    """

    def __init__(self, function: Callable[[str], bytes | None], most: int) -> None:
        super().__init__()
        self.function, self.most, self.older = function, most, {}

    def __missing__(self, key: str) -> bytes | None:
        if len(key) > 64:
            return self.function(key)
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    def __init__(self, source: str) -> None:
        self.vocabulary = Vocabulary(source)
        self.strings = [self.vocabulary.strings.get(i, b"") for i in range(max(self.vocabulary.strings) + 1)]
        self.pieces = regex.compile(PIECES).findall
        self.known = _Remembered(self._piece, CACHE_PIECES)
        self.words = _Remembered(self._word, CACHE_WORDS)
        self.whole_word = regex.compile(r"\S(?:.*\S)?", regex.DOTALL).fullmatch
        self.single_spaces = regex.compile(r"(?<=\S) (?=\S)").split
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def _piece(self, piece: str) -> bytes:
        symbols = self.vocabulary.merge(piece.encode())
        return pack(f"<{len(symbols)}I", *symbols)

    def _word(self, word: str) -> bytes | None:
        """Tokens of a space and a word; None if white space at its ends could join what lies around it."""
        return b"".join([self.known[piece] for piece in self.pieces(" " + word)]) if self.whole_word(word) else None

    def _plain(self, text: str) -> list[bytes]:
        """Tokens of a text without special tokens.

        A single space between two other characters always begins a piece, so what lies between such
        spaces can be encoded, and remembered, by itself.
        """
        first, *rest = text.split(" ")
        words = self.words
        packed = [words[word] for word in rest]
        if None in packed or not first or first[-1].isspace():
            first, *rest = self.single_spaces(text)
            packed = [
                words[word] or b"".join([self.known[piece] for piece in self.pieces(" " + word)]) for word in rest
            ]
        return [*[self.known[piece] for piece in self.pieces(first)], *packed]

    def encode(self, text: str) -> bytes:
        """Tokens as little-endian unsigned 32-bit integers."""
        special = self.vocabulary.special
        out = []
        for part in self.specials.split(text) if self.specials else [text]:
            if part in special:
                out.append(special[part].to_bytes(4, "little"))
            elif part:
                out.extend(self._plain(part))
        return b"".join(out)

    def decode(self, tokens: np.ndarray) -> str:
        """Text of the tokens; bytes that are no UTF-8 become replacement characters."""
        strings = self.strings
        return b"".join([strings[i] for i in tokens.tolist()]).decode("utf-8", "replace")


def codec_of(source: str) -> Codec:
    """The codec of a worker, kept for its next tasks."""
    return kept(Codec, source)


def read_tokenizer(path: str) -> str:
    """JSON text of a tokenizer file; a few MB whatever the corpus, shipped to the tasks."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _with(df: DataFrame, columns: list[str], name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*only(df, *columns).schema.fields, T.StructField(name, kind)])


def _lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<u4").astype("int32")))


def encode(df: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = (), ids: str = "ids") -> DataFrame:
    """Columns ``keep`` and the tokens of ``text`` as an array of integers.  ``tokenizer``: see :func:`read_tokenizer`."""
    source = df.sparkSession.sparkContext.broadcast(tokenizer)

    def make():
        codec = codec_of(source.value)

        def step(batch: pa.RecordBatch):
            return [*batch.columns[: len(keep)], _lists([codec.encode(x) for x in as_text(batch.column(len(keep)))])]

        return step

    return map_batches(only(df, *keep, text), _with(df, list(keep), ids, T.ArrayType(T.IntegerType())), make)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", keep: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """Columns ``keep`` and the text of the tokens; null or no tokens give the empty text."""
    source = df.sparkSession.sparkContext.broadcast(tokenizer)

    def make():
        codec = codec_of(source.value)

        def step(batch: pa.RecordBatch):
            rows = batch.column(len(keep)).to_pylist()
            return [*batch.columns[: len(keep)], [codec.decode(np.array(r or [], "int64")) for r in rows]]

        return step

    return map_batches(only(df, *keep, ids), _with(df, list(keep), text, T.StringType()), make)


ROUND_TRIP = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
]


def round_trip(
    df: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = (), with_ids: bool = False
) -> DataFrame:
    """Columns ``keep``, the number of tokens, and digests of the tokens and of the text decoded from them.

    ``with_ids`` adds the tokens as an array ``ids``.

    Encodes and decodes in one pass, so that the tokens themselves are not moved between processes.
    """
    source = df.sparkSession.sparkContext.broadcast(tokenizer)

    def make():
        codec = codec_of(source.value)

        def step(batch: pa.RecordBatch):
            counts, ids, texts, every = [], [], [], []
            for value in as_text(batch.column(len(keep))):
                packed = codec.encode(value)
                if with_ids:
                    every.append(packed)
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                texts.append(hashlib.sha256(codec.decode(np.frombuffer(packed, "<u4")).encode()).hexdigest())
            return [*batch.columns[: len(keep)], counts, ids, texts, *([_lists(every)] if with_ids else [])]

        return step

    found = [*ROUND_TRIP, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])]
    return map_batches(only(df, *keep, text), T.StructType([*only(df, *keep).schema.fields, *found]), make)
