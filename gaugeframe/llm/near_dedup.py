"""Near-duplicate groups by circulant MinHash, banding and exact verification.

A document's set is its distinct word shingles. Two permutations of a fixed universe give the whole
signature: the first scatters the shingles, the second is read at every circular shift, so the
coordinates of one shingle are a slice of a table and a signature is the minimum over slices.

Texts with equal sets collapse to one node, named by a 128-bit digest of the set, before anything is compared; sets too small to
be linked with a different one go no further. In a bucket every node is
compared with the bucket's most central node only; nodes that this leaves in another component
are then compared with those others that counts per hash segment around the pivot do not rule out. Groups of copies thus
cost a comparison per member, and no link that banding proposes is lost.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.common import fresh, per_batch, raw_text, words_of
from gaugeframe.operators.duplicates import connected_components
from gaugeframe.runtime import cut, tune

UNIVERSE = 1 << 22
COORDINATES = 128
BANDS = 32
MIX = np.uint64(0x9E3779B97F4A7C15)
SEGMENTS = 64
BLOCK_ROWS = 512


class _WordIds(dict):
    """64-bit ids of words; the memo is emptied before it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(columns, length: int, seed: int) -> np.ndarray:
    """An order-sensitive 64-bit mix of the columns."""
    h = np.full(length, seed, dtype=np.uint64)
    for column in columns:
        h = (h ^ column) * MIX
        h ^= h >> np.uint64(29)
    return h


def shingle_set(raw: bytes, words: int, ids: dict) -> np.ndarray:
    """Sorted distinct shingle hashes; with fewer words than ``words`` the whole sequence is one shingle."""
    tokens = words_of(raw)
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    values = np.fromiter((ids[t] for t in tokens), dtype=np.uint64, count=len(tokens))
    width = min(words, len(values))
    n = len(values) - width + 1
    return np.unique(_mixed((values[j:j + n] for j in range(width)), n, width))


class CirculantMinHash:
    """Signatures from two seeded permutations of one universe."""

    def __init__(self, seed: int = 7, coordinates: int = COORDINATES, bands: int = BANDS, universe: int = UNIVERSE):
        rng = np.random.default_rng(seed)
        self.first = rng.permutation(universe).astype(np.int32)
        second = rng.permutation(universe).astype(np.int32)
        ring = np.concatenate([second, second[:coordinates]])
        self.shifts = np.lib.stride_tricks.sliding_window_view(ring, coordinates)
        self.coordinates, self.bands, self.universe = coordinates, bands, universe

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        cells = self.first[(shingles % np.uint64(self.universe)).astype(np.int64)]
        best = np.full(self.coordinates, np.iinfo(np.int32).max, dtype=np.int32)
        for start in range(0, len(cells), 512):
            np.minimum(best, self.shifts[cells[start:start + 512]].min(axis=0), out=best)
        return best

    def band_keys(self, shingles: np.ndarray) -> np.ndarray:
        rows = self.signature(shingles).reshape(self.bands, -1).astype(np.uint64)
        numbered = [np.arange(self.bands, dtype=np.uint64), *rows.T]
        return _mixed(numbered, self.bands, 1).view(np.int64)


@lru_cache(maxsize=2)
def _hasher(seed: int) -> CirculantMinHash:
    """One per worker; its tables are the same in every task."""
    return CirculantMinHash(seed)


def signatures(docs: DataFrame, doc_id: str, text: str, words: int, seed: int) -> DataFrame:
    """doc_id, digest (of the text, to tell rows of one id apart), n_shingles, set_key (null for an empty set), bands."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def make():
        ids, hasher = _WordIds(), _hasher(seed)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, keys, bands = [], [], []
            for raw in batch.column(2):
                shingles = shingle_set(raw.as_py(), words, ids)
                sizes.append(len(shingles))
                keys.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                bands.append(hasher.band_keys(shingles) if len(shingles) else np.empty(0, dtype=np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands)))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists],
                names=["doc_id", "digest", "n_shingles", "set_key", "bands"])
        return work

    return per_batch(_rows(docs, doc_id, text), make, f"doc_id {kind}, digest bigint, n_shingles bigint, set_key binary, bands array<bigint>")


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(raw_text(text)).alias("digest"), raw_text(text).alias("raw"))


def _sets(docs: DataFrame, needed: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """node, shingles (sorted 64-bit hashes as bytes) of the needed nodes; ``needed`` names a row (doc_id, digest) of each."""
    def make():
        ids = _WordIds()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(raw.as_py(), words, ids).tobytes() for raw in batch.column(1)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])
        return work

    wanted = _rows(docs, doc_id, text).join(needed.hint("shuffle_hash"), ["doc_id", "digest"])
    return cut(per_batch(wanted.select("node", "raw"), make, "node binary, shingles binary").dropDuplicates(["node"]))


def _segments(shingles: np.ndarray) -> np.ndarray:
    return np.bincount((shingles >> np.uint64(58)).astype(np.int64), minlength=SEGMENTS)


def _compare(pairs: DataFrame, sets: DataFrame, profiles: bool = False) -> DataFrame:
    """a, b, shared, size_a, size_b for every pair, counted on full sets.

    With ``profiles`` also the counts of a's shingles inside and outside b per hash segment, as packed numbers.
    """
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            shared, size_a, size_b, inside, outside = [], [], [], [], []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(left, dtype=np.uint64), np.frombuffer(right, dtype=np.uint64)
                both = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
                shared.append(int(both.sum()))
                size_a.append(len(x))
                size_b.append(len(y))
                if profiles:
                    inside.append(_segments(x[both]).astype("<u4").tobytes())
                    outside.append(_segments(x[~both]).astype("<u4").tobytes())
            columns = [batch.column(0), batch.column(1), *[pa.array(v, pa.int64()) for v in (shared, size_a, size_b)]]
            names = ["a", "b", "shared", "size_a", "size_b"]
            if profiles:
                columns += [pa.array(inside, pa.binary()), pa.array(outside, pa.binary())]
                names += ["inside", "outside"]
            return pa.RecordBatch.from_arrays(columns, names=names)
        return work

    joined = (pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
              .select("a", "b", "set_a", "set_b"))
    more = ", inside binary, outside binary" if profiles else ""
    return cut(per_batch(joined, make, f"a binary, b binary, shared bigint, size_a bigint, size_b bigint{more}"))


def _linked(percent: int):
    return 100 * F.col("shared") >= percent * (F.col("size_a") + F.col("size_b") - F.col("shared"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80,
                    seed: int = 7) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest reachable id), kept, digest (64 bits of the text), one row per input row.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets. A null or
    wordless text has an empty set and is linked with nothing. Rows that share an id are told apart by their
    texts. A null id takes no part: its component is null and the row is kept. Other columns are ignored.
    """
    tune(docs.sparkSession)
    signed = cut(signatures(docs, doc_id, text, words, seed))
    usable = signed.filter(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    # A set can be linked with another one only if it could with itself and one shingle more.
    large = usable.filter(100 * F.col("n_shingles") >= percent * (F.col("n_shingles") + 1))
    nodes = large.groupBy(F.col("set_key").alias("node")).agg(F.min(F.struct("doc_id", "digest")).alias("row"), F.first("bands").alias("bands"))

    buckets = nodes.select(F.explode("bands").alias("key"), "node")
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = cut(buckets.join(shared, "key"))
    central = members.groupBy("node").agg(F.sum("size").alias("weight"))
    pivots = (members.join(central, "node").groupBy("key")
              .agg(F.max(F.struct("weight", "node")).alias("top")).select("key", F.col("top.node").alias("pivot")))
    near = cut(members.join(pivots, "key").select("node", "pivot").distinct())

    pairs = near.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _sets(docs, nodes.join(asked, "node").select("node", "row.doc_id", "row.digest"), doc_id, text, words)
    stars = _compare(pairs, sets, profiles=True)
    links = stars.filter(_linked(percent)).select("a", "b")
    components = cut(connected_components(links, "a", "b"))
    more = _remaining(near, stars, components, percent)
    further = _compare(more, sets).filter(_linked(percent)).select("a", "b")
    if not further.isEmpty():
        components = cut(connected_components(links.unionByName(further), "a", "b"))

    copies = usable.groupBy(F.col("set_key").alias("node")).agg(F.min("doc_id").alias("smallest"))
    grouped = copies.join(components, "node", "left")
    first = grouped.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("smallest").alias("first"))
    labels = grouped.join(first, "component", "left").select(F.col("node").alias("set_key"), F.coalesce("first", "smallest").alias("label"))
    out = signed.select("doc_id", "digest", "n_shingles", "set_key").join(labels, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"), "digest")


def _remaining(near: DataFrame, stars: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """Pairs around one pivot that are in different components and that the pivot's counts do not rule out.

    Per hash segment two sets share at most the smaller of their counts inside the pivot, and the smaller of those
    outside. Blocks of nodes meet blocks of nodes outside the pivot's component; only pairs that pass come out.
    """
    label = lambda name: components.select(F.col("node").alias(name), F.col("component").alias(f"{name}_label"))
    rows = (near.join(stars.toDF("node", "pivot", "shared", "size", "pivot_size", "inside", "outside"), ["node", "pivot"])
            .join(label("node"), "node", "left").join(label("pivot"), "pivot", "left")
            .withColumn("label", F.coalesce("node_label", "node"))
            .withColumn("apart", F.col("label") != F.coalesce("pivot_label", "pivot")))
    rows = cut(rows.select("pivot", "node", "label", "inside", "outside", "apart"))
    count = lambda what, name: F.ceil(what / BLOCK_ROWS).cast("int").alias(name)
    blocks = rows.groupBy("pivot").agg(count(F.count(F.lit(1)), "blocks"), count(F.count_if("apart"), "apart_blocks")).filter("apart_blocks > 0")
    sized = rows.join(blocks, "pivot")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fields = ["pivot", "node", "label", "inside", "outside", "apart"]
    a = sized.filter("apart").select(*fields, place("apart_blocks").alias("i"), every("blocks").alias("j"))
    b = sized.select(*fields, place("blocks").alias("jj"), every("apart_blocks").alias("ii")).toDF(*[f"right_{f}" for f in (*fields, "j", "i")])
    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        unpack = lambda t, c: np.frombuffer(b"".join(t.column(c).to_pylist()), dtype="<u4").reshape(-1, SEGMENTS).astype(np.int64)
        plain = lambda t, c: np.array([*t.column(c).to_pylist(), None], dtype=object)[:-1]
        found_a, found_b = [], []
        if left.num_rows and right.num_rows:
            in_b, out_b, nodes_b, labels_b, apart_b = (unpack(right, "right_inside"), unpack(right, "right_outside"), plain(right, "right_node"),
                                                       plain(right, "right_label"), plain(right, "right_apart").astype(bool))
            sizes_b = in_b.sum(axis=1) + out_b.sum(axis=1)
            for in_a, out_a, node, own in zip(unpack(left, "inside"), unpack(left, "outside"), plain(left, "node"), plain(left, "label")):
                most = np.minimum(in_b, in_a).sum(axis=1) + np.minimum(out_b, out_a).sum(axis=1)
                union = in_a.sum() + out_a.sum() + sizes_b - most
                keep = (labels_b != own) & (~apart_b | (nodes_b > node)) & (100 * most >= percent * union)
                found_b += nodes_b[keep].tolist()
                found_a += [node] * int(keep.sum())
        return pa.table({"a": pa.array(found_a, pa.binary()), "b": pa.array(found_b, pa.binary())})

    pairs = a.groupBy("pivot", "i", "j").cogroup(b.groupBy("right_pivot", "right_i", "right_j")).applyInArrow(meet, "a binary, b binary")
    return cut(pairs.distinct())


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that are not the smallest of their group; columns stay as they are.

    Of rows that share an id only those whose text has a smaller copy go. Rows with null ids and whole repeated rows stay.
    """
    groups = near_duplicates(docs, doc_id, text, words, percent)
    own = fresh(docs, "digest")
    dropped = groups.filter(~F.col("kept")).select(F.col("doc_id").alias(doc_id), F.col("digest").alias(own)).distinct()
    rows = docs.withColumn(own, F.xxhash64(raw_text(text))).join(dropped, [doc_id, own], "left_anti")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
