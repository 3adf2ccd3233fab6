"""Exact copies, near duplicates and the groups they form."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.arrays import mean_abs_difference
from gaugeframe.runtime import cut

CROWD_ROWS = 512          # a key with more rows is compared in blocks
BLOCK_ROWS = 32_768       # rows of one block of a crowded key; two blocks meet in one task
PAIR_ROWS = 8192          # the same where all near pairs are wanted, which may be nearly all pairs
BUCKET_ROWS = 4096        # rows of the other keys that share a bucket, on average
PARTITION_ROWS = 65_536   # rows of tiles in a shuffle partition, where the session asks for fewer partitions
CELLS = 1 << 19           # comparisons made at once inside a task
TABLE = 1 << 13           # a word with so many pairs around it meets them as a table
TABLE_CELLS = 1 << 18     # pairs of one table
TABLE_WIDTH = 1 << 12     # rows on the right side of one table
COARSE_BINS = 32          # thumbnails are compared first in the bins that vary most
REACH = 1500              # the tolerance in the whole numbers of that comparison; 16 bins of at most 2,047 add up in 16 bits


def first_seen(records: DataFrame, content: str, path: str) -> DataFrame:
    """One row per content: its first path and the number of copies."""
    return records.groupBy(content).agg(F.min(path).alias("first_path"), F.count(F.lit(1)).alias("copies"))


def exact_duplicates(records: DataFrame, content: str = "content_hash", path: str = "path") -> DataFrame:
    """Every later copy with the first path of its content: linear in the rows, not in the pairs."""
    repeated = first_seen(records, content, path).filter(F.col("copies") > 1)
    return (records.select(content, F.col(path).alias("later_path")).join(repeated, content)
            .filter(F.col("later_path") > F.col("first_path")).select("first_path", "later_path", content))


SECTIONS = 8
SUMS = [f"s{i}" for i in range(SECTIONS)]
KEY = ["no", "bits"]
TILE = [*KEY, "low", "high"]


def band_masks(distance: int, bands: int) -> list[int]:
    """Bit masks of which at least one agrees whenever two 64-bit words differ in ``distance`` bits.

    ``distance`` flipped bits touch at most that many of the bands, so some choice of the
    other ``bands - distance`` bands agrees completely.
    """
    edges = [round(64 * i / bands) for i in range(bands + 1)]
    slices = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(slices, bands - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def bands_for(rows: int, distance: int) -> int:
    """Enough agreeing bits per key to tell the rows apart, with as few keys as possible."""
    bands = distance + 1
    while bands < 2 * distance + 2 and 64 * (bands - distance) / bands < math.log2(max(2, rows)) + 12:
        bands += 1
    return bands


def _widest(tolerance: float) -> Column:
    return F.col("size") * F.lit(tolerance * 1.000001)    # a hair wider, so rounding never parts two neighbours


def _keyed(items: DataFrame, distance: int, path: str, content: str, fingerprint: str, thumb: str, crowd_rows: int, bands: int | None,
           sums: bool = False) -> tuple[DataFrame, list[int], int]:
    """One narrow row per content and bit mask, with a mark on the rows of a crowded key, written once; the masks; the number of contents."""
    size = F.size(F.col(thumb))

    def section(i: int) -> Column:
        start, stop = F.floor(size * i / SECTIONS).cast("int"), F.floor(size * (i + 1) / SECTIONS).cast("int")
        return F.aggregate(F.slice(F.col(thumb), start + 1, stop - start), F.lit(0.0), lambda s, x: s + x)

    names = ["path", "fp", *(["size", *SUMS] if sums else [])]
    extra = [size.alias("size"), *[section(i).alias(n) for i, n in enumerate(SUMS)]] if sums else []
    narrow = items.select(content, F.col(path).alias("path"), F.col(fingerprint).alias("fp"), *extra)
    unique = cut(narrow.groupBy(content).agg(F.min_by(F.struct(*names), "path").alias("s"), F.count(F.lit(1)).alias("copies")).select("s.*", "copies"))
    contents = unique.count()
    masks = band_masks(distance, bands or bands_for(contents, distance))
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)]))
    rows = unique.filter("fp IS NOT NULL").withColumn("key", keys).select(*names, "copies", "key.no", "key.bits")
    crowds = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("crowd")).filter(F.col("crowd") > crowd_rows)
    return cut(rows.join(crowds, KEY, "left").withColumn("crowded", F.col("crowd").isNotNull()).drop("crowd")), masks, contents


def _buckets(rows: DataFrame, pictures: DataFrame, contents: int) -> DataFrame:
    """The rows of the keys that are not crowded with their thumbnails: many keys of one mask share a tile."""
    bucket = F.pmod(F.xxhash64("bits"), F.lit(math.ceil(max(1, contents) / BUCKET_ROWS)))
    none = F.lit(-1).cast("bigint")
    placed = rows.filter("NOT crowded").select("no", bucket.alias("bits"), none.alias("low"), none.alias("high"), none.alias("slot"),
                                               "path", "fp", "copies", F.lit(False).alias("hung"))
    return placed.join(pictures, "path")


def _by_tile(tiles: DataFrame, masks: list[int], contents: int):
    """Tiles grouped in a fixed number of partitions: their cost is in the comparisons, which the bytes do not show."""
    partitions = max(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), contents * len(masks) // PARTITION_ROWS)
    return tiles.repartition(partitions, *TILE).groupBy(*TILE)


def _tiles(crowd: DataFrame, pictures: DataFrame, block_rows: int) -> DataFrame:
    """The rows of crowded keys with their thumbnails, once for every tile, that is, every pair of blocks of a key, they belong to.

    Rows marked ``hung`` fill blocks of their own, behind the others, which do not meet each other: a key without other rows has no tile.
    A row travels once per block of its key, and a block of the default size holds most keys whole.
    """
    def blocks(hung: bool) -> Column:
        return F.ceil(F.count_if(F.col("hung") == hung) / block_rows).cast("bigint")

    grid = crowd.groupBy(*KEY).agg(blocks(False).alias("loose_blocks"), blocks(True).alias("hung_blocks")).filter("loose_blocks > 0")
    loose, hung = F.col("loose_blocks"), F.col("hung_blocks")
    place = F.xxhash64("path")
    slot = F.when(F.col("hung"), loose + F.pmod(place, F.greatest(hung, F.lit(1)))).otherwise(F.pmod(place, loose))
    met = F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("hung"), loose).otherwise(loose + hung) - 1))
    placed = crowd.join(grid, KEY).withColumn("slot", slot).withColumn("met", met).select(
        *KEY, F.least("slot", "met").alias("low"), F.greatest("slot", "met").alias("high"), "slot", "path", "fp", "copies", "hung")
    return placed.join(pictures, "path")


def _blocks_of(tile: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(left rows, their thumbnails, right rows, their thumbnails) of a tile, per size of thumbnail; both sides are the same inside one block."""
    slot, low, high = (tile.column(c).to_numpy() for c in ("slot", "low", "high"))
    lists = tile.column("thumb").combine_chunks()
    sizes, offsets = pc.list_value_length(lists).to_numpy(), lists.offsets.to_numpy()
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)      # a missing bin is no number
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        pictures = values[(offsets[rows] - offsets[0])[:, None] + np.arange(n)]
        whole = np.isfinite(pictures).all(axis=1)                       # others are near nothing
        rows, pictures = rows[whole], pictures[whole]
        left, right = slot[rows] == low[rows], slot[rows] == high[rows]
        if len(rows) and (left & right).all():
            yield rows, pictures, rows, pictures
        elif left.any() and right.any():
            yield rows[left], pictures[left], rows[right], pictures[right]


def _meets(tile: pa.Table, masks: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """Whether two words, given by the bits that tell them apart, agree on the mask of the tile and on none before it."""
    number = tile.column("no")[0].as_py()
    own, *earlier = [np.array(m, dtype=np.int64).view(np.uint64) for m in [masks[number], *masks[:number]]]

    def meets(apart: np.ndarray) -> np.ndarray:
        keep = (apart & own) == 0
        for m in earlier:
            keep &= (apart & m) != 0
        return keep
    return meets


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The members of all ranges, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class _Sides:
    """Both sides of a tile in the order of their fingerprints, with the bins that vary most as short whole numbers.

    The whole numbers round a value down, so two of them differ by at most the scaled difference and one: their sum bounds the difference
    from below. Values far from the middle are cut off, which only brings them nearer.
    """
    def __init__(self, words: np.ndarray, left: np.ndarray, pictures: np.ndarray, right: np.ndarray, others: np.ndarray, tolerance: float):
        self.inside, self.tolerance, self.size = left is right, tolerance, max(1, pictures.shape[1])
        middle, spread = others.mean(0), others.var(0)
        chosen = np.argsort(-spread, kind="stable")[:COARSE_BINS]
        reach = self.size * tolerance * 1.000001 + 1e-12 * max(1.0, np.abs(pictures).sum(1).max(), np.abs(others).sum(1).max())
        self.active = np.flatnonzero((pictures != 0).any(0) | (others != 0).any(0))

        def side(rows: np.ndarray, values: np.ndarray):
            order = np.argsort(words[rows], kind="stable")
            rows, values = rows[order], values[order]
            word, start, count = np.unique(words[rows], return_index=True, return_counts=True)
            short = np.clip(np.floor((values[:, chosen] - middle[chosen]) * (REACH / reach)) + 1024, 0, 2047).astype(np.int16)
            return rows, np.ascontiguousarray(values.T), np.ascontiguousarray(short.T), word, start, count
        self.rows, self.values, self.short, self.word, self.start, self.count = side(left, pictures)
        self.rows_, self.values_, self.short_, self.word_, self.start_, self.count_ = (
            (self.rows, self.values, self.short, self.word, self.start, self.count) if self.inside else side(right, others))

    def narrowed(self, a: np.ndarray, b: np.ndarray, first: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that the bins from ``first`` on do not part, where the bins before differ by ``total``."""
        while first < len(self.short) and len(a):
            last = min(len(self.short), first + 8)
            for k in range(first, last):
                total = total + np.abs(self.short[k][a] - self.short_[k][b])
            keep = total <= REACH + last
            a, b, total, first = a[keep], b[keep], total[keep], last
        return a, b

    def exact(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        difference = np.zeros(len(a))
        for k in self.active:                              # in the order of the bins, as the column expression adds
            difference += np.abs(self.values[k][a] - self.values_[k][b])
        return difference / self.size

    def block(self, top: int, stop: int, others: np.ndarray, short: np.ndarray, wanted: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Near pairs of the rows from ``top`` to ``stop`` with all of ``others``, compared as a table; ``short`` are the first bins of these."""
        bins = len(short)
        total, step = np.zeros((stop - top, len(others)), dtype=np.int16), np.empty((stop - top, len(others)), dtype=np.int16)
        for k in range(bins):
            np.subtract(self.short[k, top:stop, None], short[k], out=step)
            np.abs(step, out=step)
            total += step
        close = total <= REACH + bins
        if self.inside:
            close &= others[None, :] > np.arange(top, stop)[:, None]
        if np.count_nonzero(close) * 4 < close.size:
            close = np.flatnonzero(close)
            a, b = np.divmod(close, len(others))
            a, b = self.narrowed(a + top, others[b], bins, total.ravel()[close].astype(np.int32))
            return self.verified(a, b, wanted)
        difference, step = np.zeros(total.shape), np.empty(total.shape)
        for k in self.active:
            np.subtract(self.values[k, top:stop, None], self.values_[k][others], out=step)
            np.abs(step, out=step)
            difference += step
        difference /= self.size
        a, b = np.nonzero(close & (difference <= self.tolerance))
        difference, a, b = difference[a, b], a + top, others[b]
        keep = wanted(self.rows[a], self.rows_[b])
        return a[keep], b[keep], difference[keep]

    def verified(self, a: np.ndarray, b: np.ndarray, wanted: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keep = wanted(self.rows[a], self.rows_[b])
        a, b = a[keep], b[keep]
        difference = self.exact(a, b)
        keep = difference <= self.tolerance
        return a[keep], b[keep], difference[keep]


def _near_rows(words: np.ndarray, left: np.ndarray, pictures: np.ndarray, right: np.ndarray, others: np.ndarray, distance: int, tolerance: float,
               meets: Callable[[np.ndarray], np.ndarray], wanted: Callable[[np.ndarray, np.ndarray], np.ndarray],
               ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(left rows, right rows, bits apart, mean difference) of all near pairs between two blocks, a bounded number of comparisons at a time.

    ``words`` are the fingerprints of the tile. Each word of a side is compared once with each of the other, whatever the rows that share
    it; the rows of two near words then meet in the bins that vary most and, where these leave them, in all bins. A word with many rows around
    it meets them as a table, other words meet theirs as one list of pairs. Inside one block, given as the same array twice, a pair is met once.
    """
    sides = _Sides(words, left, pictures, right, others, tolerance)

    def found(a: np.ndarray, b: np.ndarray, difference: np.ndarray):
        one, other = sides.rows[a], sides.rows_[b]
        return one, other, np.bitwise_count(words[one] ^ words[other]).astype(np.int32), difference

    rows = max(1, CELLS // len(sides.word_))
    for top in range(0, len(sides.word), rows):
        first = top if sides.inside else 0                  # words are in order: inside a block the later ones are enough
        apart = sides.word[top:top + rows, None] ^ sides.word_[None, first:]
        i, j = np.nonzero(np.bitwise_count(apart) <= distance)
        keep = meets(apart[i, j])
        i, j = i[keep] + top, j[keep] + first
        if sides.inside:
            i, j = i[j >= i], j[j >= i]
        met = sides.count[i] * sides.count_[j]
        around = np.bincount(i, met, minlength=len(sides.word))
        many = around[i] >= TABLE
        for word in np.unique(i[many]):
            near = j[np.searchsorted(i, word):np.searchsorted(i, word, side="right")]
            theirs = _spans(sides.start_[near], sides.count_[near])
            begin, end = sides.start[word], sides.start[word] + sides.count[word]
            for b in range(0, len(theirs), TABLE_WIDTH):
                part = theirs[b:b + TABLE_WIDTH]
                short, step = sides.short_[:16].take(part, axis=1), TABLE_CELLS // len(part)
                for a in range(begin, end, step):
                    pairs = sides.block(a, min(end, a + step), part, short, wanted)
                    if len(pairs[0]):
                        yield found(*pairs)
        i, j, met = i[~many], j[~many], met[~many]
        cuts = np.searchsorted(np.cumsum(met), np.arange(CELLS, met.sum() + CELLS, CELLS))
        for begin, end in zip([0, *cuts], [*cuts, len(i)]):
            x, y, n = i[begin:end], j[begin:end], met[begin:end]
            pair, place = np.repeat(np.arange(len(x)), n), _spans(np.zeros(len(n), dtype=np.int64), n)
            across = sides.count_[y][pair]
            a, b = sides.start[x][pair] + place // across, sides.start_[y][pair] + place % across
            if sides.inside:
                a, b = a[b > a], b[b > a]
            a, b = sides.narrowed(a, b, 0, np.zeros(len(a), dtype=np.int32))
            if len(a):
                pairs = sides.verified(a, b, wanted)
                if len(pairs[0]):
                    yield found(*pairs)


def _tile_pairs(masks: list[int], distance: int, tolerance: float):
    """The near pairs of a tile that no earlier mask agrees on."""
    columns = ["left_path", "right_path", "hamming", "difference", "left_copies", "right_copies"]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = pa.Table.from_batches(batches)
        words = tile.column("fp").to_numpy().astype(np.int64, copy=False).view(np.uint64)
        path, copies = tile.column("path").combine_chunks(), tile.column("copies").combine_chunks()
        rank = pc.rank(path, tiebreaker="min").to_numpy().astype(np.int64)
        for blocks in _blocks_of(tile):
            for a, b, bits, difference in _near_rows(words, *blocks, distance, tolerance, _meets(tile, masks), lambda a, b: rank[a] != rank[b]):
                a, b = np.where(rank[a] < rank[b], a, b), np.where(rank[a] < rank[b], b, a)
                yield pa.RecordBatch.from_arrays([path.take(pa.array(a)), path.take(pa.array(b)), pa.array(bits), pa.array(difference),
                                                  copies.take(pa.array(a)), copies.take(pa.array(b))], names=columns)
    return pairs


def near_duplicates(items: DataFrame, distance: int = 2, tolerance: float = 0.004, path: str = "path",
                    content: str = "content_hash", fingerprint: str = "fp", thumb: str = "thumb",
                    crowd_rows: int = CROWD_ROWS, part_rows: int = PAIR_ROWS, bands: int | None = None) -> DataFrame:
    """Pairs of different contents within the Hamming distance and the mean difference.

    Equal content is collapsed to its first path first, so copies cost nothing here; each pair
    states how many copies stand behind both sides. Candidates share a bit mask, and the masks miss nothing (``band_masks``). Thumbnails
    travel with the rows: the small keys of a mask share buckets, a crowded key is cut into blocks of about ``part_rows`` rows that meet in
    tiles, and only near pairs leave a task. A pair is reported only by the first mask on which it agrees, so nothing is emitted twice.
    """
    rows, masks, contents = _keyed(items, distance, path, content, fingerprint, thumb, crowd_rows, bands)
    pictures = items.select(F.col(path).alias("path"), F.col(thumb).alias("thumb")).filter("thumb IS NOT NULL")
    crowd = rows.filter("crowded").select(*KEY, "path", "fp", "copies", F.lit(False).alias("hung"))
    tiles = _tiles(crowd, pictures, part_rows).unionByName(_buckets(rows, pictures, contents))
    return _by_tile(tiles, masks, contents).applyInArrow(
        _tile_pairs(masks, distance, tolerance), "left_path string, right_path string, hamming int, difference double, left_copies long, right_copies long")


def _tile_forest(masks: list[int], distance: int, tolerance: float):
    """A spanning forest of the links of a tile that no earlier mask agrees on; rows marked ``hung`` count as linked already."""
    def forest(tile: pa.Table) -> pa.Table:
        words = tile.column("fp").to_numpy().astype(np.int64, copy=False).view(np.uint64)
        path, hung = tile.column("path").combine_chunks(), np.flatnonzero(tile.column("hung").to_numpy())
        label = np.arange(tile.num_rows)
        label[hung] = hung[:1].repeat(len(hung))
        ends: list[tuple[int, int]] = []
        for blocks in _blocks_of(tile):
            for a, b, _, _ in _near_rows(words, *blocks, distance, tolerance, _meets(tile, masks), lambda a, b: label[a] != label[b]):
                _, first = np.unique(label[a] * len(label) + label[b], return_index=True)       # one link per two parts
                for x, y in zip(a[first].tolist(), b[first].tolist()):
                    if label[x] != label[y]:
                        ends.append((x, y))
                        label[label == label[y]] = label[x]
        chosen = np.array(ends, dtype=np.int64).reshape(-1, 2)
        return pa.table({"left_path": path.take(pa.array(chosen[:, 0])), "right_path": path.take(pa.array(chosen[:, 1]))})
    return forest


def near_forest(items: DataFrame, distance: int = 2, tolerance: float = 0.004, path: str = "path", content: str = "content_hash",
                fingerprint: str = "fp", thumb: str = "thumb", crowd_rows: int = CROWD_ROWS, block_rows: int = BLOCK_ROWS,
                bands: int | None = None) -> DataFrame:
    """Edges (left_path, right_path) that connect the same contents as ``near_duplicates``, without the pairs of a crowd.

    Keys of at most ``crowd_rows`` rows share buckets. A crowded key takes the first row of its fullest cell of section sums as pivot,
    and every row near the pivot hangs on it by one edge: two such rows are connected and never compared. The other rows meet each other and
    the hung ones in tiles of two blocks of about ``block_rows`` rows. A tile or bucket returns a spanning forest, so never more edges than it
    has rows. Every edge is a pair within both limits.
    Rows without a fingerprint, thumbnail or content link with nothing.
    """
    usable = items.filter(F.col(fingerprint).isNotNull() & F.col(thumb).isNotNull() & F.col(content).isNotNull())
    rows, masks, contents = _keyed(usable, distance, path, content, fingerprint, thumb, crowd_rows, bands, sums=True)
    pictures = usable.select(F.col(path).alias("path"), F.col(thumb).alias("thumb"))
    cell = F.array(*[F.floor(F.col(n) / _widest(tolerance)).cast("bigint") for n in SUMS])
    crowd = rows.filter("crowded").select(*KEY, "path", "fp", "copies", cell.alias("cell"))
    fullest = (crowd.groupBy(*KEY, "cell").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
               .groupBy(*KEY).agg(F.max_by("path", F.struct("n", "path")).alias("pivot")))
    pivots = fullest.join(crowd.select(*KEY, F.col("path").alias("pivot"), F.col("fp").alias("pivot_fp")), [*KEY, "pivot"]).join(
        pictures.toDF("pivot", "pivot_thumb"), "pivot")
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot_fp"))) <= distance) & (F.size("thumb") == F.size("pivot_thumb")) & (
        mean_abs_difference(F.col("thumb"), F.col("pivot_thumb")) <= tolerance)
    crowd = cut(crowd.join(pivots, KEY).join(pictures, "path").select(      # the thumbnails are not kept
        *KEY, "path", "fp", "copies", "pivot", F.coalesce(near, F.lit(False)).alias("hung")))
    hanging = crowd.filter(F.col("hung") & (F.col("path") != F.col("pivot"))).select(F.col("pivot").alias("left_path"), F.col("path").alias("right_path"))
    tiles = _tiles(crowd.drop("pivot"), pictures, block_rows).unionByName(_buckets(rows, pictures, contents))
    kept = _by_tile(tiles, masks, contents).applyInArrow(_tile_forest(masks, distance, tolerance), "left_path string, right_path string")
    return hanging.unionByName(kept).distinct()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edge table; a component is named by its smallest node.

    Alternates the two star operations: each round hangs the larger neighbours of a node on its
    smallest neighbour, then the smaller ones. Every round ends in reliable storage.
    """
    current = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    mark = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(lowest, "u")
        small = (hung.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(lowest.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        current = cut(small)
        seen = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark is not None and tuple(seen) == mark:
            nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
        mark = tuple(seen)
    raise RuntimeError("components did not settle; raise max_rounds")


def similarity_groups(records: DataFrame, near: DataFrame, content: str = "content_hash", path: str = "path") -> DataFrame:
    """Every record with its group: the smallest path among all exact and near relatives.

    The graph holds one node per content, so copies never enter it.
    """
    first = first_seen(records, content, path)
    components = connected_components(near, "left_path", "right_path")
    groups = first.join(components.withColumnRenamed("node", "first_path"), "first_path", "left").select(
        content, F.coalesce("component", "first_path").alias("group"))
    return records.join(groups, content)


def quarantine(records: DataFrame, group: str = "group", split: str = "split", sealed: str = "test") -> DataFrame:
    """Training rows whose group also occurs in the sealed split are marked; sealed rows stay as they are."""
    touched = records.filter(F.col(split) == sealed).select(group).distinct().withColumn("__touched", F.lit(True))
    joined = records.join(touched, group, "left")
    role = (F.when(F.col(split) == sealed, sealed).when(F.col("__touched"), "quarantined").otherwise("training"))
    return joined.withColumn("role", role).drop("__touched")
