"""Byte-level BPE by longest matches that backtrack over a pair-compatibility check.

An Aho-Corasick automaton gives the longest token at every position. A token may follow another
only if merging their bytes from scratch would keep both; where no shorter prefix fits either, the previous
token is taken back. Every position is given up at most once, so the work is linear in the text. Decoding gathers
bytes from one blob by an offset table.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.common import per_batch, raw_text
from gaugeframe.runtime import tune

# The white space of the splitting pattern, and the contractions it keeps.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
MEMO_ENTRIES = 200_000         # with keys of up to MEMO_LENGTH characters, some 40 MB a worker
PAIR_ENTRIES = 200_000         # some 20 MB a worker
MEMO_LENGTH = 64
ROWS_AT_ONCE = 128             # of a batch, so many texts are held with their ids and decoded bytes


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte: printable Latin-1 stands for itself, others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


@lru_cache(maxsize=1)
def _classes() -> tuple[str, str]:
    """Character classes of letters and of numbers, as ranges."""
    spans: dict[str, list[list[int]]] = {"L": [], "N": []}
    for point in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(point))[0]
        if kind in spans:
            rows = spans[kind]
            if rows and rows[-1][1] == point - 1:
                rows[-1][1] = point
            else:
                rows.append([point, point])
    return tuple("".join(rf"\U{a:08x}-\U{b:08x}" for a, b in spans[k]) for k in "LN")


@lru_cache(maxsize=1)
def splitters() -> tuple[re.Pattern, re.Pattern]:
    """The coarse split at white space, and the full split inside a stretch without white space (but for one leading blank)."""
    letters, numbers = _classes()
    coarse = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
    fine = re.compile(f"{CONTRACTIONS}| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACE}{letters}{numbers}]+|[{SPACE}]+")
    return coarse, fine


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, model: dict):
        symbols = _byte_symbols()
        vocabulary, merges = model["model"]["vocab"], model["model"]["merges"]
        surface = {i: bytes(symbols[c] for c in token) for token, i in vocabulary.items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        for content, i in self.special.items():
            surface[i] = content.encode()
        self.size = max(surface) + 1
        self.tokens = [surface.get(i, b"") for i in range(self.size)]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(pairs):
            a, b = vocabulary[left], vocabulary[right]
            self.rank.setdefault((a, b), rank)
            self.parts.setdefault(vocabulary[left + right], (a, b, rank))
        self.id_of = {surface[i]: i for i in vocabulary.values()}
        specials = set(self.special.values())
        self.compatible: dict[int, bool] = {}
        self.reachable = self._reachable(surface, specials)
        self.id_of = {s: i for s, i in self.id_of.items() if i in self.reachable}
        matcher = ahocorasick.Automaton()
        for i, s in enumerate(self.tokens):
            if s and i in self.reachable:
                matcher.add_word(s.decode("latin-1"), i)
        matcher.make_automaton()
        self.matcher = matcher
        self.lengths = [len(t) for t in self.tokens]
        self.shorter = [-1] * self.size
        for s, i in self.id_of.items():
            self.shorter[i] = self._prefix(s)
        self.fine = splitters()[1].findall
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        lengths = np.array(self.lengths, dtype=np.int64)
        self.blob = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])

    def _reachable(self, surface: dict[int, bytes], specials: set[int]) -> set[int]:
        """Tokens that merging their own bytes from scratch gives; a longest match must not be any other."""
        good = {i for i, s in surface.items() if len(s) == 1 and i not in specials}
        for token, (left, right, rank) in sorted(self.parts.items(), key=lambda x: x[1][2]):
            if left in good and right in good and self._fits(left, right, rank):
                good.add(token)
        return good

    def _prefix(self, surface: bytes) -> int:
        """The longest token that is a proper prefix; -1 for none."""
        for n in range(len(surface) - 1, 0, -1):
            if (i := self.id_of.get(surface[:n])) is not None:
                return i
        return -1

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens from scratch gives just these two; kept in the pair table."""
        if len(self.compatible) >= PAIR_ENTRIES:
            self.compatible.clear()
        known = self.compatible[left * self.size + right] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int, limit: int = sys.maxsize) -> bool:
        """Undo merges latest first along the seam; no pair there may merge before the merge that covers it."""
        rank, parts = self.rank, self.parts
        while True:
            across = rank.get((left, right))
            if across is not None and across < limit:
                return False
            a, b = parts.get(left), parts.get(right)
            if a is None and b is None:
                return True
            # Undo the later merge; of equal merges the right one came later, so ties of rank count against it.
            if b is None or (a is not None and a[2] > b[2]):
                limit, left = a[2], a[1]
            else:
                limit, right = b[2] + 1, b[0]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one stretch of the splitting pattern; the automaton is asked for the longest token where one must start."""
        if (whole := self.id_of.get(piece)) is not None:
            return [whole]
        text, stop, size = piece.decode("latin-1"), len(piece), self.size
        lengths, shorter, known, search = self.lengths, self.shorter, self.compatible, self.matcher.iter_long
        open_at = bytearray(b"\x01") * (stop + 1)
        out: list[int] = []
        at, last, token = 0, -1, next(search(text))[1]
        while True:
            end = at + lengths[token]
            if open_at[end]:
                fits = last < 0 or known.get(last * size + token)
                if fits is None:
                    fits = self.fits(last, token)
                if fits:
                    out.append(token)
                    if end == stop:
                        return out
                    at, last = end, token
                    token = next(search(text, at))[1]
                    continue
            token = shorter[token]
            while token < 0:
                open_at[at] = 0
                token = out.pop()
                at -= lengths[token]
                token = shorter[token]
                last = out[-1] if out else -1

    def encode_stretch(self, stretch: str) -> bytes:
        """Ids, packed as little-endian 32-bit numbers, of one stretch of the coarse split."""
        ids: list[int] = []
        for piece in self.fine(stretch):
            ids += self.merge(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str, memo: dict[str, bytes]) -> bytes:
        """Packed ids of a whole text; strings of special tokens become their ids."""
        coarse = splitters()[0]
        out = []
        for part in (self.split_special.split(text) if self.split_special else [text]):
            if part in self.special:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
            else:
                out.extend(map(memo.__getitem__, coarse.findall(part)))
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        """Bytes of packed ids: a gather from the blob by the offset table."""
        ids = np.frombuffer(packed, dtype="<u4").astype(np.int64)
        starts, lengths = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        return self.blob[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()


class Memo(dict):
    """Packed ids of short stretches, emptied before it grows large; long ones are encoded each time."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, stretch: str) -> bytes:
        packed = self.codec.encode_stretch(stretch)
        if len(stretch) <= MEMO_LENGTH:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[stretch] = packed
        return packed


@lru_cache(maxsize=2)
def _hold(name: str) -> list:
    """One place per vocabulary and worker for the codec that its tasks share."""
    return []


def codec_of(name: str, model) -> Codec:
    place = _hold(name)
    if not place:
        place.append(Codec(json.loads(model())))
    return place[0]


def load(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian 32-bit numbers), decoded (bytes), one row per input row.

    Null text is empty and has no tokens; repeated ids are separate rows; other columns are ignored. The vocabulary
    file (a path) is read once by the driver and sent to the tasks as it is, so no worker keeps it parsed beside its codec.
    """
    spark = tune(docs.sparkSession)
    shared = spark.sparkContext.broadcast(load(vocabulary))
    kind = docs.schema[doc_id].dataType.simpleString()

    def make():
        codec = codec_of(vocabulary, lambda: shared.value)
        memo = Memo(codec)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = [codec.encode(raw.as_py().decode("utf-8", "replace"), memo) for raw in batch.column(1)]
            sizes = pa.array([len(p) // 4 for p in packed], pa.int64())
            decoded = pa.array([codec.decode(p) for p in packed], pa.binary())
            return pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(packed, pa.binary()), decoded],
                                              names=["doc_id", "n_tokens", "ids", "decoded"])
        return work

    return per_batch(docs.select(F.col(doc_id).alias("doc_id"), raw_text(text).alias("raw")), make,
                     f"doc_id {kind}, n_tokens bigint, ids binary, decoded binary", rows=ROWS_AT_ONCE)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def encode_with_digests(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256."""
    return encode(docs, vocabulary, doc_id, text).select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
