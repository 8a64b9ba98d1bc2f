"""MinHash near-duplicate detection by min-max hashing (operator 7).

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so the number of
hash evaluations is half the number of values. Bands of four values (two permutations) are hashed to buckets.
Documents with equal shingle sets form a class, which takes part once. Within a bucket every class is compared
with the bucket's smallest member, its centre. Members of a bucket that this leaves in different components are
compared, tile by tile, if their bits allow it: of 1,024 bits, one for each minimum and maximum under 512 more permutations, two
sets at the threshold differ in more than the allowed number once in ten million pairs. So a group of near copies
is not expanded to its pairs, and every link is confirmed on the full shingle sets.

With 20 bands of four values, two sets at similarity s meet in a bucket with probability 1 - (1 - s^4)^20: all but
4 in ten million at 0.85.

Nulls and ties: a null text has no shingles; a text without shingles is linked with nothing and is its own
component; a null id is linked with nothing, gets a null component and is kept; rows with equal ids are one
document, whose links are those of all its texts; a tie is decided by the smaller id. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .components import components
from .words import WordHashes, mixed, shingle_set

BANDS, PERMUTATIONS_OF_BAND = 20, 2
#: Words of a shingle; nodes of a tile.
SHINGLE, TILE = 5, 256


def multipliers(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def signatures(sets: list[np.ndarray], bands: int, per_band: int) -> np.ndarray:
    """A row of ``bands`` bucket keys for each (non-empty) set."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), bands), np.uint64)
    factors = multipliers(bands * per_band)
    for band in range(bands):
        key = np.full(len(sets), band + 1, np.uint64)
        for f in factors[band * per_band : (band + 1) * per_band]:
            x = flat * f
            for least in (np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)):
                key = mixed(key ^ least) * np.uint64(31)
        out[:, band] = mixed(key)
    return out


def batch_sets(column: pa.Array, hashes: WordHashes, shingle: int) -> list[np.ndarray]:
    return [shingle_set(t.lower().split(), hashes, shingle) for t in base.text_bytes(column)]


def sketch(docs: DataFrame, bands: int, per_band: int, shingle: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, bands): k1 and k2 identify the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                sets = batch_sets(b["text"], hashes, shingle)
                n = np.array([len(s) for s in sets], np.int64)
                full = [s for s in sets if len(s)]
                keys = signatures(full, bands, per_band) if full else np.empty((0, bands), np.uint64)
                k = np.zeros((2, len(sets)), np.uint64)
                for i, s in enumerate(sets):
                    k[0, i], k[1, i] = s.sum(dtype=np.uint64), mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                lists = base.list_array(keys.reshape(-1).view(np.int64), np.where(n > 0, bands, 0), pa.int64())
                yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array(n), pa.array(k[0].view(np.int64)), pa.array(k[1].view(np.int64)), lists], ["doc_id", "n_shingles", "k1", "k2", "bands"])

    return docs.mapInArrow(base.rested(run), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def agreement_bits(sets: list[np.ndarray], words: int) -> np.ndarray:
    """``words`` 64-bit words for each (non-empty) set: one bit of each minimum and maximum under 32 permutations a word."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.zeros((len(sets), words), np.uint64)
    factors = multipliers(words * 32 + 1000)[1000:]
    for k, f in enumerate(factors):
        x = flat * f
        for least in (np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)):
            out[:, k // 32] = (out[:, k // 32] << np.uint64(1)) | (mixed(least) & np.uint64(1))
    return out


def shingle_sets(docs: DataFrame, named: base.KeyFilter, shingle: int, words: int) -> DataFrame:
    """(doc_id, items, bits): the whole set of each named document as ascending unsigned 64-bit hashes, and its bits."""
    has = named.test()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for every in batches:
            whole = every.filter(has(every["place"]))
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                sets = batch_sets(b["text"], hashes, shingle)
                n = np.array([len(s) for s in sets])
                full = [s for s in sets if len(s)]
                bits = agreement_bits(full, words) if full else np.empty((0, words), np.uint64)
                lists = base.list_array(np.concatenate(sets).view(np.int64), n, pa.int64())
                yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), lists, base.list_array(bits.reshape(-1).view(np.int64), np.where(n > 0, words, 0), pa.int64())], ["doc_id", "items", "bits"])

    rows = docs.withColumn("place", named.place(F.col("doc_id").cast("long")))
    return rows.mapInArrow(base.rested(run), "doc_id long, items array<long>, bits array<long>").where(F.size("items") > 0)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    other = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    both = pairs.join(one, "a").join(other, "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            i, x = base.list_parts(t["x"])
            j, y = base.list_parts(t["y"])
            x, y = x.view(np.uint64), y.view(np.uint64)
            keep = np.zeros(t.num_rows, bool)
            for k in range(t.num_rows):
                p, q = x[i[k] : i[k + 1]], y[j[k] : j[k + 1]]
                if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                    common = int((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum())
                    keep[k] = 100 * common >= percent * (len(p) + len(q) - common)
            yield pa.RecordBatch.from_arrays([t["a"], t["b"]], ["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(base.rested(compare), "a long, b long").distinct()


def shared_buckets(members: DataFrame) -> DataFrame:
    """(band, bucket, node, centre) for buckets with several nodes; the centre is the smallest.

    The centres are stored first, so that the join back to the members is a plain one that Spark can split.
    """
    centres = members.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre != last").select("bucket", "centre")
    return members.join(base.stored(centres, "centres"), "bucket").where("node != centre")


def far_bits(percent: int, words: int) -> int:
    """The most bits of all in which two sets at the similarity differ, but for one pair in ten million (5.3 sigma)."""
    n, differ = 64 * words, (1 - percent / 100) / 2
    return int(n * differ + 5.3 * (n * differ * (1 - differ)) ** 0.5) + 1


def left_apart(shared: DataFrame, found: DataFrame, sketches: DataFrame, percent: int, words: int, tile: int = TILE) -> DataFrame:
    """Pairs (a, b) of one bucket in different components whose bits allow a link, each in its first common band.

    One of the two is outside the bucket's largest component, a minor one. A bucket is cut into tiles of about ``tile``
    nodes and its minor nodes once more; each pair of an outer and a minor tile is a group of its own, so no task holds
    a bucket, and one that its centre has all but united is hardly copied.
    """
    rows = shared.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = base.stored(rows.select("band", "bucket", "node", "component"), "labelled")
    shares = base.stored(rows.groupBy("bucket", "component").agg(F.count("*").alias("n")), "shares")
    split = shares.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n")).where(F.col("n") > F.col("main.n"))
    tiles = lambda n: F.ceil(n / tile).cast("long")
    split = split.select("bucket", F.col("main.component").alias("main"), tiles(F.col("n")).alias("tiles"), tiles(F.col("n") - F.col("main.n")).alias("minor_tiles"))
    apart = base.stored(rows.join(base.stored(split, "split"), "bucket").join(sketches, "node"), "apart")
    place = lambda n: F.pmod(F.xxhash64("node"), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    carried = ["bucket", "band", "node", "component", "bits", "bands"]
    outer = apart.select(*carried, place(F.col("tiles")).alias("i"), each("minor_tiles").alias("j"), F.lit(0).alias("side"))
    minor = apart.where("component != main").select(*carried, each("tiles").alias("i"), place(F.col("minor_tiles")).alias("j"), F.lit(1).alias("side"))
    dealt = outer.unionByName(minor).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")
    most = far_bits(percent, words)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in base.runs_of(batches, ["bucket", "i", "j"]):
            node, component, side = (group[c].to_numpy() for c in ("node", "component", "side"))
            bits, bands = (base.list_parts(group[c])[1].reshape(len(node), -1) for c in ("bits", "bands"))
            band, (left, right) = int(group["band"][0].as_py()) - 1, (np.flatnonzero(side == k) for k in (0, 1))
            for x in right.tolist():
                some = left[component[left] != component[x]]
                some = some[np.bitwise_count(bits[some] ^ bits[x]).sum(axis=1) <= most]
                some = some[(bands[some] == bands[x]).argmax(axis=1) == band]
                if len(some):
                    y = np.full(len(some), node[x])
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[some], y)), pa.array(np.maximum(node[some], y))], ["a", "b"])

    return dealt.mapInArrow(base.rested(compare), "a long, b long").distinct()


@base.scoped("near_duplicates")
def near_duplicates(docs: DataFrame, percent: int = 85, bands: int = BANDS, per_band: int = PERMUTATIONS_OF_BAND, shingle: int = SHINGLE, words: int = 16) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): links are pairs with 100 * intersection >= percent * union."""
    source = base.texts(docs)
    rows = base.stored(sketch(source, bands, per_band, shingle), "sketch")
    usable = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = base.stored(usable.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "bands")).alias("r")).select("k1", "k2", F.col("r.doc_id").alias("node"), F.col("r.bands").alias("bands")), "classes")
    members = classes.select(F.posexplode("bands").alias("band", "bucket"), "node").withColumn("band", F.col("band") + 1)
    shared = base.stored(shared_buckets(members), "shared")
    stars = base.stored(shared.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    # Texts stay where they lie: a bitmap lets those through that may be of a shared bucket, the joins of ``confirmed`` decide.
    named = base.KeyFilter(stars.select(F.explode(F.array("a", "b")).alias("doc_id")))
    sets = base.stored(shingle_sets(source, named, shingle, words), "sets")
    links = base.stored(confirmed(stars, sets, percent), "confirmed")
    found = components(links)
    sketches = sets.select(F.col("doc_id").alias("node"), "bits").join(classes.select("node", "bands"), "node").distinct()
    rest = base.stored(left_apart(shared, found, sketches, percent, words), "rest")
    more = base.stored(confirmed(rest, sets, percent), "confirmed")
    if not more.isEmpty():
        found = components(links.unionByName(more))

    of_class = classes.join(found, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("class_component"))
    out = rows.join(of_class, ["k1", "k2"], "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("class_component")).otherwise(F.col("doc_id")))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
