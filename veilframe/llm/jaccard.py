"""n-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersections.

A document's set holds the hashes of its distinct shingles, of 3 words if not told otherwise. Two sets
link when their Jaccard similarity reaches a threshold. The join is exact:

1. Equal sets (by 128 bits of their elements) are one node, so copies cost
   nothing beyond the first.
2. Sizes fall into bands. Sets x, y with |x| <= |y| that link differ in at
   most d = |x| * (1 - t) / t elements. In x's band, hash space is cut into
   more slices than d allows to differ, so linked sets agree on a whole
   slice. A tile is the sets of a band that agree on a slice. A set joins the
   tiles of its own band, and of the band below if a partner could be there.
3. Each tile's first node is its hub, in one of a few orders of the nodes.
   Pairs with hubs pass if bit counts of the two bitmap signatures allow
   enough overlap, then the sorted arrays are intersected. Links make
   components.
4. Tiles whose members are all in one component are done: a dense group of
   near copies costs a few pairs a member, not all pairs. In the other tiles,
   pairs from different components go the same way (bit counts, then exact).
   A large tile is dealt in pairs of blocks, so that no task holds more than
   two blocks of it.

Texts of candidates are fetched by document and travel compressed; sets are
made again from them, so that no table of whole sets is ever stored.

Defined results: null, empty and wordless texts have an empty set and link
with nothing; texts with fewer words than a shingle have one, the whole
sequence; rows that share a doc_id but not a text are separate nodes; an empty
table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import Recent, join_null_safe, lookup, settled, sliced, written
from veilframe.llm.components import components

#: Words of a shingle; the threshold as a fraction.
SHINGLE = 3
NUMERATOR, DENOMINATOR = 90, 100
#: A band's upper size by its lower; slices beyond the least number, so that empty slices needn't make tiles.
BAND_RATIO = 1.5
SPARE = 1
#: Bits of a signature for each element, about: many, so that the bound is close to the overlap.
BITS = 8
#: Orders of nodes by which tiles choose hubs, and members of a block of a tile whose pairs are compared in one go.
ORDERS = 8
BLOCK = 512
#: Bytes of words and their hashes that a worker keeps, about; pairs that a task remembers so as not to repeat them.
KEPT_BYTES = 48 << 20
PAIRS_SEEN = 100_000
#: Bits of a node's first id. Sets that share one get ids of their own, see _numbered.
NODE_BITS = 64

_C = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(seed: int) -> Recent:
    """64-bit hashes of a task's recent words."""
    return Recent(lambda word: xxhash.xxh3_64_intdigest(word, seed=seed), KEPT_BYTES, 160)


def shingles(text: str | None, hashes: Recent, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles. bytes.lower and bytes.split know ASCII only, as wanted."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    width = min(size, len(w))
    n = len(w) - width + 1
    total = np.full(n, np.uint64(width))
    for k in range(width):
        total = mixed(total * _C[k % 3] + w[k : k + n])
    return np.unique(total)


@cache
def _lowers(least: int) -> list[int]:
    """The bands' lower sizes, to beyond any text's."""
    out = [least]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * BAND_RATIO))))
    return out


@dataclass(frozen=True)
class Bands:
    """Size bands and their slices for a threshold numerator/denominator.

    Under 0.9, a slice for each element that may differ would leave many
    slices empty, and the tiles of empty slices hold unrelated sets. There a
    third more slices are spare.
    """

    numerator: int = NUMERATOR
    denominator: int = DENOMINATOR

    def least(self) -> int:
        """The smallest size at which different sets can link: (t / (1 - t), rounded up)."""
        return -(-self.numerator // (self.denominator - self.numerator))

    def lower(self, band: int) -> int:
        return _lowers(self.least())[band]

    def of(self, size: int) -> int:
        """The band of a size, -1 under all."""
        return bisect_right(_lowers(self.least()), size) - 1

    def most(self, band: int) -> int:
        """Elements in which linked sets of a band can differ."""
        return (self.lower(band + 1) - 1) * (self.denominator - self.numerator) // self.numerator

    def spare(self, band: int) -> int:
        """Slices beyond the least number."""
        return SPARE if 10 * self.numerator >= 9 * self.denominator else max(SPARE, -(-self.most(band) // 3))

    def slices(self, band: int) -> int:
        return self.most(band) + 1 + self.spare(band)

    def joined(self, size: int) -> list[int]:
        """The bands whose tiles a set joins."""
        band = self.of(size)
        if band < 0:
            return []
        below = band > 0 and self.numerator * size <= self.denominator * (self.lower(band) - 1)
        return [band, band - 1] if below else [band]


def tiles(h: np.ndarray, bands: Bands) -> np.ndarray:
    """The tiles of a sorted set: a hash of band, slice and the slice's elements.

    Slices are ranges of hash space, so they are runs of the sorted array.
    Empty slices make tiles only for sets with more than the band's spare number: other
    linked pairs agree on a slice that has elements.
    """
    out = []
    for band in bands.joined(len(h)):
        m = bands.slices(band)
        at = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        used = at[starts]
        sums = np.add.reduceat(mixed(h ^ _C[0]), starts)
        counts = np.diff(np.r_[starts, len(h)]).astype(np.uint64)
        if m - len(used) > bands.spare(band):
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), used)
            used, sums, counts = np.r_[used, empty], np.r_[sums, np.zeros_like(empty)], np.r_[counts, np.zeros_like(empty)]
        out.append(mixed(mixed(sums + counts * _C[1]) ^ (used * _C[2] + np.uint64(band + 1))))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def bitmap(h: np.ndarray, bands: Bands) -> np.ndarray:
    """A signature of BITS times the band's upper size in bits, to the next power of two, as 64-bit words."""
    bits = max(64, 1 << (BITS * bands.lower(bands.of(len(h)) + 1) - 1).bit_length())
    set_bits = np.zeros(bits, np.uint8)
    set_bits[(h & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(set_bits, bitorder="little").view(np.uint64)


def set_key(h: np.ndarray, seed: int) -> bytes | None:
    """128 bits of a set; null if it is empty."""
    return xxhash.xxh3_128_digest(h.tobytes(), seed=seed) if len(h) else None


def _signatures(seed: int, bands: Bands, size: int, node_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = word_hashes(seed), set()  # copies of a set in one task make tiles once
        for batch in sliced(batches):
            sizes, nodes, keys, all_tiles, maps = [], [], [], [], []
            for text in batch.column("text"):
                h = shingles(text.as_py(), hashes, size)
                sizes.append(len(h))
                digest = set_key(h, seed)
                keys.append(digest)
                nodes.append(int.from_bytes(digest[:8], "little", signed=True) >> (64 - node_bits) if digest else None)
                linkable = bands.of(len(h)) >= 0 and digest not in seen
                seen.add(digest)
                all_tiles.append(tiles(h, bands).view(np.int64) if linkable else np.empty(0, np.int64))
                maps.append(bitmap(h, bands).view(np.int64) if linkable else np.empty(0, np.int64))

            def lists(values: list[np.ndarray]) -> pa.ListArray:
                offsets = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
                return pa.ListArray.from_arrays(offsets, np.concatenate(values) if values else np.empty(0, np.int64))

            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.binary()), lists(all_tiles), lists(maps)],
                names=[*(c for c in batch.schema.names if c != "text"), "n_shingles", "node", "set_key", "tiles", "bits"],
            )

    return run


def _packed(seed: int, size: int):
    """Rows (node, set_key, text): the compressed texts of those whose set has that key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, pack = word_hashes(seed), zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches):
            nodes, blobs = [], []
            for node, key, text in zip(*(batch.column(c).to_pylist() for c in ("node", "set_key", "text")), strict=True):
                if set_key(shingles(text, hashes, size), seed) == key:
                    nodes.append(node)
                    blobs.append(pack.compress(text.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], names=["node", "packed"])

    return run


def _linked(seed: int, numerator: int, denominator: int, size: int):
    """Of rows (a, b, packed_a, packed_b), the pairs that link. Neighbouring rows share b, whose set is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unpack = word_hashes(seed), zstandard.ZstdDecompressor()
        kept, x = None, None

        def made(blob: bytes) -> np.ndarray:
            return shingles(unpack.decompress(blob).decode("utf-8", "surrogatepass"), hashes, size)

        for batch in batches:
            a, b, pa_, pb = (batch.column(c) for c in ("a", "b", "packed_a", "packed_b"))
            out = []
            for i in range(batch.num_rows):
                if (now := b[i].as_py()) != kept:
                    kept, x = now, made(pb[i].as_py())
                y = made(pa_[i].as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                if denominator * both >= numerator * (len(x) + len(y) - both):
                    out.append((a[i].as_py(), now))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    return run


def _folded(bits: Column, to: Column) -> Column:
    """A bitmap halved (or twice, or more) to a shorter one's length: bit i of n keeps i mod n/2."""
    width = F.size(to)
    return F.when(F.size(bits) <= width, bits).otherwise(
        F.transform(
            F.sequence(F.lit(0), width - 1),
            lambda i: F.aggregate(F.sequence(i, F.size(bits) - 1, width), F.lit(0).cast("long"), lambda acc, k: acc.bitwiseOR(F.get(bits, k))),
        )
    )


def overlap_bound(bits_a: Column, n_a: Column, bits_b: Column, n_b: Column) -> Column:
    """An upper bound of the overlap: each bit that only one side has stands for an element that only it has."""
    x, y = _folded(bits_a, bits_b), _folded(bits_b, bits_a)
    pairs = F.zip_with(x, y, lambda p, q: F.struct(F.bit_count(p.bitwiseAND(F.bitwise_not(q))).alias("a"), F.bit_count(q.bitwiseAND(F.bitwise_not(p))).alias("b")))
    only = F.aggregate(pairs, F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")), lambda s, v: F.struct((s["a"] + v["a"]).alias("a"), (s["b"] + v["b"]).alias("b")))
    return F.least(n_a - only["a"], n_b - only["b"])


def _may_link(a: str, b: str, numerator: int, denominator: int) -> Column:
    """The test by sizes, then by bit counts."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = denominator * F.least(n_a, n_b) >= numerator * F.greatest(n_a, n_b)
    bound = overlap_bound(F.col(f"{a}.bits"), n_a, F.col(f"{b}.bits"), n_b)
    return F.when(~sizes, F.lit(False)).otherwise((denominator + numerator) * bound >= numerator * (n_a + n_b))


def _across(numerator: int, denominator: int):
    """Rows of blocks of tiles, neighbours by (tile, low, high), to the pairs (a, b) of different labels that bit counts let pass.

    A group holds the members of two blocks of a tile, or of one.
    """

    def passing(table: pa.Table) -> Iterator[tuple[int, int]]:
        node, label, n, block = (table.column(c).to_numpy() for c in ("node", "label", "n", "block"))
        if label.min() == label.max():
            return
        lists = table.column("bits").combine_chunks()
        flat, widths = lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy()
        ends, width = np.cumsum(widths), int(widths.min())
        bits = np.stack([np.bitwise_or.reduce(flat[end - w : end].reshape(-1, width), axis=0) for end, w in zip(ends.tolist(), widths.tolist(), strict=True)])
        one_block = table.column("low")[0] == table.column("high")[0]
        for i in range(len(node)):
            other = (label != label[i]) & (denominator * np.minimum(n, n[i]) >= numerator * np.maximum(n, n[i]))
            other &= (node > node[i]) if one_block else (block > block[i])
            at = np.flatnonzero(other)
            if not len(at):
                continue
            only_i = np.bitwise_count(bits[i] & ~bits[at]).sum(axis=1, dtype=np.int64)
            only_other = np.bitwise_count(bits[at] & ~bits[i]).sum(axis=1, dtype=np.int64)
            bound = np.minimum(n[i] - only_i, n[at] - only_other)
            for j in at[(denominator + numerator) * bound >= numerator * (n[at] + n[i])].tolist():
                yield int(min(node[i], node[j])), int(max(node[i], node[j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # pairs that this task has let pass; only saves repetition

        def new(group: pa.Table) -> Iterator[tuple[int, int]]:
            for pair in passing(group) if group.num_rows > 1 else ():
                if pair not in seen:
                    if len(seen) >= PAIRS_SEEN:
                        seen.clear()
                    seen.add(pair)
                    yield pair

        for group in grouped(batches, ("tile", "low", "high")):
            pairs = new(group)
            while some := list(islice(pairs, PAIRS_SEEN)):
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in some], pa.int64()), pa.array([p[1] for p in some], pa.int64())], names=["a", "b"])

    return run


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys, also where a run goes on in the next batch. Keys are whole numbers without nulls."""
    parts: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(c).to_numpy() for c in keys])
        starts = np.flatnonzero(np.r_[True, (values[:, 1:] != values[:, :-1]).any(axis=0)]).tolist()
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(values[:, start].tolist())
            if parts and key != last:
                yield pa.Table.from_batches(parts)
                parts = []
            last = key
            parts.append(batch.slice(start, end - start))
    if parts:
        yield pa.Table.from_batches(parts)


def _exact(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, seed: int, numerator: int, denominator: int, size: int) -> DataFrame:
    """The pairs (a, b) of nodes that link, written."""
    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "doc_id", "set_key"), "node")
    texts = join_null_safe(docs.select("doc_id", "text"), lookup(written(wanted, "wanted")), ["doc_id"], "inner").select("node", "set_key", "text")
    packed = written(texts.mapInArrow(_packed(seed, size), "node long, packed binary"), "packed").dropDuplicates(["node"])
    packed = written(packed, "packed")
    with_a = pairs.join(packed.select(F.col("node").alias("a"), F.col("packed").alias("packed_a")), "a")
    with_b = with_a.join(packed.select(F.col("node").alias("b"), F.col("packed").alias("packed_b")), "b")
    return written(with_b.select("a", "b", "packed_a", "packed_b").mapInArrow(_linked(seed, numerator, denominator, size), "a long, b long"), "links")


def jaccard_components(docs: DataFrame, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, seed: int = 0, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text), as a written table; size is the words of a shingle."""
    return settled(docs.sparkSession, lambda: _joined(docs, numerator, denominator, seed, size), "components")


def _text_hash() -> Column:
    return F.xxhash64("text")


def _numbered(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sets, and nodes (node, doc_id, set_key), where every distinct set_key has a node id of its own.

    Ids of 64 bits save half of the largest shuffles. Among very many sets a
    few share an id; all of these get another one from their 128-bit key, and
    only these, until every id is one set's.
    """
    turn = 0
    while True:
        nodes = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("set_key").alias("set_key"), F.max("set_key").alias("other"))
        nodes = written(nodes, "nodes")
        shared = nodes.where("set_key <> other")
        if shared.isEmpty():
            return sets, nodes.select("node", "doc_id", "set_key")
        turn += 1
        own = sets.join(lookup(written(shared.select("node"), "shared")), "node", "left_semi").select("set_key").distinct()
        own = lookup(written(own.withColumn("own", F.xxhash64("set_key", F.lit(turn))), "own"))
        sets = written(sets.join(own, "set_key", "left").withColumn("node", F.coalesce("own", "node")).select(*sets.columns), "sets")


def _joined(docs: DataFrame, numerator: int, denominator: int, seed: int, size: int, by_text: bool = False) -> DataFrame:
    """The join; by_text, (doc_id, text_hash, label) of the rows with a set, where label is the component's."""
    bands = Bands(numerator, denominator)
    schema = "doc_id long, " + "text_hash long, " * by_text + "n_shingles long, node long, set_key binary, tiles array<long>, bits array<long>"
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[_text_hash().alias("text_hash")] * by_text, "text")
    sets, nodes = _numbered(written(read.mapInArrow(_signatures(seed, bands, size, NODE_BITS), schema), "sets"))

    placed = sets.select("node", F.explode("tiles").alias("tile"))
    order = F.xxhash64(F.pmod("tile", F.lit(ORDERS)))
    ordered = F.col("node").bitwiseXOR(order)
    hubs = placed.groupBy("tile").agg(F.min(ordered).alias("first"), F.max(ordered).alias("last")).where(F.col("first") != F.col("last"))
    hubs = hubs.select("tile", F.col("first").bitwiseXOR(order).alias("hub"))
    members = written(placed.join(written(hubs, "hubs"), "tile").distinct(), "members")

    signature = written(
        sets.where(F.size("bits") > 0).join(lookup(written(members.select("node").distinct(), "member_nodes")), "node", "left_semi").groupBy("node").agg(F.first(F.struct(F.col("n_shingles").alias("n"), "bits")).alias("s")),
        "signatures",
    )
    stars = members.where(F.col("node") != F.col("hub")).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()

    def of(side: str) -> DataFrame:
        return signature.select(F.col("node").alias(side), F.col("s").alias(f"s_{side}"))

    likely = stars.join(of("a"), "a").join(of("b"), "b").where(_may_link("s_a", "s_b", numerator, denominator))
    links = _exact(likely, docs, nodes, seed, numerator, denominator, size)
    labels = components(links)

    placed_label = written(members.join(lookup(labels), "node", "left").withColumn("label", F.coalesce("label", "node")), "placed")
    open_tiles = placed_label.groupBy("tile").agg(F.min("label").alias("p"), F.max("label").alias("q"), F.count(F.lit(1)).alias("members")).where(F.col("p") != F.col("q"))
    open_tiles = lookup(written(open_tiles.select("tile", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "open_tiles"))
    blocked = placed_label.select("tile", "node", "label").join(open_tiles, "tile").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("tile", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "label")
    signed = dealt.join(signature.select("node", "s.n", "s.bits"), "node")
    rows = signed.repartition("tile", "low", "high").sortWithinPartitions("tile", "low", "high")
    across = rows.select("tile", "low", "high", "block", "node", "label", "n", "bits").mapInArrow(_across(numerator, denominator), "a long, b long")
    more = _exact(across, docs, nodes, seed, numerator, denominator, size)
    final = components(links.union(more))

    class_ids = nodes.select("node", "doc_id").join(final, "node", "left").withColumn("label", F.coalesce("label", "node"))
    if by_text:
        return sets.select("doc_id", "text_hash", "node").join(class_ids.select("node", "label"), "node").select("doc_id", "text_hash", "label")
    ids = class_ids.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_node = written(class_ids.select("node", "label").join(written(ids, "ids"), "label").select("node", "component_id"), "by_node")
    return sets.select("doc_id", "n_shingles", "node").join(by_node, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, seed: int = 0, size: int = SHINGLE) -> DataFrame:
    """docs with one document of each component, that with the smallest doc_id (null after all others), then text hash.

    A document is a doc_id and a text: texts that share a doc_id are judged
    each for itself, and repeated rows leave one. Documents with an empty set
    stay.
    """
    found = settled(docs.sparkSession, lambda: _joined(docs, numerator, denominator, seed, size, by_text=True), "rows")
    ranked = found.withColumn("row", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash"))
    first = written(ranked.groupBy("label").agg(F.min("row").alias("first")), "first")
    rest = ranked.join(first, "label").where(~F.col("row").eqNullSafe(F.col("first"))).select("doc_id", F.col("text_hash").alias("__t")).distinct()
    marked = docs.withColumn("__t", _text_hash())
    left = join_null_safe(marked, lookup(written(rest, "gone")), ["doc_id", "__t"], "left_anti")
    shared = lookup(written(marked.groupBy("doc_id", "__t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("doc_id", "__t"), "repeated"))
    once = join_null_safe(left, shared, ["doc_id", "__t"], "left_anti")
    return once.union(join_null_safe(left, shared, ["doc_id", "__t"], "left_semi").dropDuplicates(["doc_id", "text"])).drop("__t")
