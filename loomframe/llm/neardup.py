"""Near-duplicate groups: MinHash bands propose candidates, odd sketches of the MinHash samples
estimate their similarity from the population count of an XOR, and full shingle sets confirm links.

1. Documents with one and the same shingle set fold into a class, named by a 128-bit digest.
2. Each class has bands of MinHash values. Two classes of similarity s share a band with
   probability 1 - (1 - s^rows)^bands; at the threshold 0.8, with 40 bands of 6, that misses 5 in a
   million links.
3. Two rounds of stars propose candidates in buckets (band and value): each class with the smallest
   of its buckets' first members, then the first member of each component in a bucket with the
   bucket's first. So a group of any size gives no more candidates than it has members and buckets.
   Sketches drop those that cannot be links; full sets confirm the rest; links are joined up.
4. In buckets whose members then still lie in several components, members of different components
   are compared in blocks, by sketch, and those with a plausible partner again, by full set, most
   similar first, until the components meet. Only confirmed links come out. So no link between members of a bucket is
   lost, and no list of pairs is made.
5. Components are the classes' connected components; every step is a join or aggregate with
   reliable checkpoints, and nothing but counters reaches the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomframe.llm._common import columns_of, map_bytes, quoted, staged, unused

SKETCH_BITS = 512
#: How far below the threshold an estimate may lie before a candidate is given up: about six
#: standard errors of 240 samples folded into 512 bits.
MARGIN = 0.2
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("p")
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers["p"] = have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have[0][:n], have[1][:n]


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the lower-cased words: polynomials by prefix sums modulo 2**64, mixed."""
    buffer = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate([[True], _IS_BLANK[buffer], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(buffer))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(_LOWER[buffer] + np.uint64(1)) * up)])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(raw: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words is one shingle."""
    words = word_hashes(raw) if raw else np.zeros(0, np.uint64)
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix(out * _BASE + words[k : len(words) - size + 1 + k])
    return np.unique(out)


def shingle_set(raw: bytes, size: int) -> set:
    """The shingles themselves."""
    words = raw.lower().split()
    size = min(size, len(words))
    return set(zip(*[words[k:] for k in range(size)], strict=False)) if words else set()


def signatures(sets: list[np.ndarray], bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """MinHash values, a row for each (non-empty) set."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    out = np.empty((len(sets), bands * rows), np.uint32)
    at = 0
    while at < len(sets):  # some thousand shingles at a time, to stay in caches
        end, held = at, 0
        while end < len(sets) and (end == at or held + len(sets[end]) <= 1 << 14):
            held += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        low = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : end - 1]])]).astype(np.int64)
        for i in range(bands * rows):
            v = low * factors[i] + shifts[i]
            v ^= v >> np.uint32(15)
            out[at:end, i] = np.minimum.reduceat(v * factors[-1 - i], starts)
        at = end
    return out


def band_keys(signs: np.ndarray, bands: int) -> np.ndarray:
    rows = signs.shape[1] // bands
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signs), 1))
    for k in range(rows):
        keys = mix(keys * _BASE + signs[:, k::rows].astype(np.uint64))
    return keys.astype(np.int64)


def odd_sketches(signs: np.ndarray) -> np.ndarray:
    """Parities of where the samples (index and value) fall among SKETCH_BITS, as 8 longs a row."""
    n, k = signs.shape
    spots = mix(signs.astype(np.uint64) * _BASE + np.arange(1, k + 1, dtype=np.uint64)) % np.uint64(SKETCH_BITS)
    flat = (np.arange(n, dtype=np.int64)[:, None] * SKETCH_BITS + spots.astype(np.int64)).ravel()
    odd = (np.bincount(flat, minlength=n * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, SKETCH_BITS), axis=1).view(np.int64)


def estimate(different_bits: Column, samples: int) -> Column:
    """Similarity from the number of bits in which two odd sketches differ; 0 when they differ in
    half of their bits or more, where nothing can be told beyond that it is low."""
    left = 1 - 2 * different_bits / F.lit(float(SKETCH_BITS))
    return F.when(left > 0, 1 + F.lit(SKETCH_BITS / (4 * samples)) * F.log(left)).otherwise(0.0)


def most_different(threshold: float, samples: int) -> int:
    """Most different bits at which the estimate is still within MARGIN of the threshold."""
    return int(SKETCH_BITS / 2 * (1 - math.exp((threshold - MARGIN - 1) * 4 * samples / SKETCH_BITS)))


def fingerprints(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """Staged: for each row of docs its number of shingles, and the set's digest, band keys and odd
    sketch (null where the set is empty). row_id is unique in the written table."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("content"), F.monotonically_increasing_id().alias("row_id"), "text")
    longs = T.ArrayType(T.LongType())
    schema = T.StructType(
        [
            *texts.drop("text").schema.fields,
            T.StructField("n_shingles", T.LongType()),
            T.StructField("node", T.BinaryType()),
            T.StructField("keys", longs),
            T.StructField("sketch", longs),
        ]
    )

    def run(others: dict, raw: list[bytes | None]) -> dict:
        sets = [shingle_hashes(t, shingle) for t in raw]
        some = [i for i, s in enumerate(sets) if len(s)]
        node: list = [None] * len(raw)
        keys: list = [None] * len(raw)
        sketch: list = [None] * len(raw)
        signs = signatures([sets[i] for i in some], bands, rows)
        for i, k, o in zip(some, band_keys(signs, bands).tolist(), odd_sketches(signs).tolist(), strict=True):
            node[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
            keys[i], sketch[i] = k, o
        return others | {"n_shingles": [len(s) for s in sets], "node": node, "keys": keys, "sketch": sketch}

    return staged(map_bytes(texts, run, schema), "fingerprints")


def shared_buckets(classes: DataFrame) -> DataFrame:
    """Staged: key, node and first (the smallest node) for the buckets of two or more classes."""
    buckets = classes.select("node", F.explode("keys").alias("key"))
    first = buckets.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    return staged(buckets.join(first.drop("n"), "key"), "buckets")


def leader_pairs(buckets: DataFrame) -> DataFrame:
    """a, b: each node that is not first everywhere, with the smallest first of its buckets."""
    least = buckets.groupBy(F.col("node").alias("b")).agg(F.min("first").alias("a"))
    return least.where(F.col("a") != F.col("b")).select("a", "b")


def with_components(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    named = buckets.join(labels, "node", "left")
    return named.select("key", "node", F.coalesce("component", "node").alias("component"))


def component_pairs(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b: in each bucket the first node with the first node of each other component."""
    heads = with_components(buckets, labels).groupBy("key", "component").agg(F.min("node").alias("b"))
    first = heads.groupBy("key").agg(F.min("b").alias("a"), F.count("*").alias("n")).where(F.col("n") > 1)
    return heads.join(first, "key").where(F.col("a") != F.col("b")).select("a", "b").distinct()


def plausible(pairs: DataFrame, classes: DataFrame, threshold: float, samples: int) -> DataFrame:
    """The pairs whose set sizes and odd sketches allow the threshold."""
    left = classes.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("s_a"))
    right = classes.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("s_b"))
    bits = F.aggregate(
        F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x
    )
    sizes = F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b")
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(sizes & (bits <= F.lit(most_different(threshold, samples))))
        .select("a", "b", estimate(bits.cast("double"), samples).alias("estimate"))
    )


def texts_of(nodes: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Staged: node and text of the classes in nodes. The join deals every text of docs once, unless
    the classes wanted are few enough to be broadcast; no text moves more often than that, but for
    candidates."""
    wanted = classes.join(nodes, "node", "left_semi").select("node", F.col("doc_id").alias("id"), "content")
    source = docs.select("doc_id", F.xxhash64("text").alias("content_"), "text")
    same = source["doc_id"].eqNullSafe(wanted["id"]) & (source["content_"] == wanted["content"])
    found = source.join(wanted, same).select("node", F.col("text").cast("binary").alias("text"))
    return staged(found.dropDuplicates(["node"]), "texts")


def reaches(x: set, y: set, percent: int) -> bool:
    shared = len(x & y)
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold. A class in very many pairs is a hot
    key of an equi-join, which AQE splits."""
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(
        texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a"
    )
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, set())
        for batch in batches:
            keep = []
            for a, x, y in zip(*(batch.column(n) for n in ("a", "text_a", "text_b")), strict=True):
                if last[0] != a.as_py():  # rows come sorted by a from a sort-merge join
                    last = (a.as_py(), shingle_set(x.as_py(), shingle))
                keep.append(reaches(last[1], shingle_set(y.as_py(), shingle), percent))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, pairs.select("a", "b").schema)


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node in links, by minimum labels
    with pointer jumping. Each round halves the distances that are left and is checkpointed."""
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = staged(edges, "edges")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component"))
    labels = staged(labels, "labels")
    while True:
        near = (
            edges.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("c").alias("near"))
        )
        lower = labels.join(near, "node").select("node", F.least("component", "near").alias("c"), "component")
        lower = staged(lower, "lower")
        jump = lower.select(F.col("node").alias("c"), F.col("c").alias("beyond"))
        new = staged(
            lower.join(jump, "c", "left").select(
                "node", F.least(F.col("c"), F.coalesce("beyond", "c")).alias("component"), F.col("component").alias("old")
            ),
            "labels",
        )
        if new.where(F.col("component") != F.col("old")).isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")


def block_members(named: DataFrame, block: int) -> DataFrame:
    """key, i, j, own, node, component: for the buckets of several components, each member in every
    pair of blocks (i <= j) in which it is compared; own is its block. A component of block members or
    more has blocks of its own, which are not compared with each other; the others share blocks."""
    of_component = named.groupBy("key", "component").agg(F.count("*").alias("m"))
    group_ = F.when(F.col("m") >= block, F.col("component"))  # null: the shared blocks
    sizes = of_component.groupBy("key", group_.alias("large")).agg(F.sum("m").alias("m"), F.count("*").alias("kinds"))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    before = Window.partitionBy("key").orderBy("large").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("key")
    placed = sizes.select(
        "key", "large", "blocks",
        F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("int").alias("first"),
        F.sum("blocks").over(whole).cast("int").alias("all"),
        F.sum("kinds").over(whole).alias("components"),
        F.sum("m").over(whole).alias("n"),
    ).where((F.col("components") > 1) & (F.col("n") > 2))
    kept = of_component.select(F.col("key").alias("k"), F.col("component").alias("c"), group_.alias("g"))
    placed = placed.join(kept, (placed["key"] == kept["k"]) & placed["large"].eqNullSafe(kept["g"]))
    none = F.array().cast("array<int>")
    upto = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(none)
    last = F.col("all") - 1
    others = F.when(F.col("large").isNull(), upto(F.lit(0), last)).otherwise(
        F.concat(upto(F.lit(0), F.col("first") - 1), upto(F.col("first") + F.col("blocks"), last))
    )
    return (
        named.join(placed.drop("key"), (F.col("key") == F.col("k")) & (F.col("component") == F.col("c")))
        .withColumn("own", F.col("first") + F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(others))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component")
    )


@dataclass
class Block:
    """The members of one pair of blocks, or of many, as arrays."""

    rows: pa.RecordBatch
    edge: np.ndarray  # where a pair of blocks begins, and the end
    i: np.ndarray
    j: np.ndarray
    own: np.ndarray
    component: np.ndarray  # small numbers
    size: np.ndarray
    sketch: np.ndarray

    @classmethod
    def of(cls, rows: pa.RecordBatch) -> Block:
        column = lambda n: rows.column(n).to_numpy(zero_copy_only=False)
        key, i, j = column("key"), column("i"), column("j")
        new = (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
        edge = np.concatenate([[0], np.flatnonzero(new) + 1, [rows.num_rows]])
        component = rows.column("component").dictionary_encode().indices.to_numpy()
        sketch = rows.column("sketch").flatten().to_numpy().astype(np.int64).reshape(-1, SKETCH_BITS // 64).view(np.uint64)
        return cls(rows, edge, i, j, column("own"), component, column("n_shingles"), sketch)

    def close(self, start: int, end: int, threshold: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the pair of blocks in rows start to end: rows a and b of each plausible pair of different
        components, most similar first."""
        here = np.arange(start, end)
        same = self.i[start] == self.j[start]
        left = here if same else here[self.own[start:end] == self.i[start]]
        right = here if same else here[self.own[start:end] == self.j[start]]
        a, b, bits = [], [], []
        step = max(1, (1 << 16) // max(1, len(right)))  # pairs at a time, for the arrays made of them
        for at in range(0, len(left), step):
            x, y = (m.ravel() for m in np.meshgrid(left[at : at + step], right, indexing="ij"))
            ok = self.component[x] != self.component[y]
            if same:
                ok &= x < y
            x, y = x[ok], y[ok]
            fits = np.minimum(self.size[x], self.size[y]) >= threshold * np.maximum(self.size[x], self.size[y])
            x, y = x[fits], y[fits]
            different = np.bitwise_count(self.sketch[x] ^ self.sketch[y]).sum(axis=1)
            near = different <= most
            a.append(x[near])
            b.append(y[near])
            bits.append(different[near])
        a, b, bits = np.concatenate(a), np.concatenate(b), np.concatenate(bits)
        order = np.lexsort((b, a, bits))
        return a[order], b[order]


def by_blocks(work: Callable[[Block], Iterator[pa.RecordBatch]]) -> Callable:
    """For mapInArrow over rows sorted by key, i, j: work on whole pairs of blocks. Of one that reaches
    into the next batch the rows are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and any(batch.column(n)[-1] != held[0].column(n)[0] for n in ("key", "i", "j")) or not held:
                rows = pa.concat_batches([*held, batch])
                last = Block.of(rows).edge[-2]
                held = [rows.slice(last)]
                if last:
                    yield from work(Block.of(rows.slice(0, last)))
            else:
                held.append(batch)
        if held:
            yield from work(Block.of(pa.concat_batches(held)))

    return run


def remaining_links(
    buckets: DataFrame, classes: DataFrame, labels: DataFrame, texts: DataFrame, shingle: int, threshold: float,
    samples: int, block: int,
) -> DataFrame:
    """a, b: links that join different components within a bucket, enough of them to join all that
    the bucket's links join. Buckets are compared in blocks of about block members, two at a time,
    so a task holds two blocks whatever the bucket's size.

    First by sketches alone: what comes out are not pairs but the members that have a plausible partner
    in another component, once for each pair of blocks. Only these get their texts, and are compared
    again, by full sets, until their components meet."""
    most, percent = most_different(threshold, samples), round(threshold * 100)
    members = block_members(with_components(buckets, labels), block)
    members = members.join(classes.select("node", "n_shingles", "sketch"), "node")

    def plausible_members(block: Block) -> Iterator[pa.RecordBatch]:
        found = [x for start, end in pairwise(block.edge) for x in block.close(start, end, threshold, most)]
        yield block.rows.take(pa.array(np.unique(np.concatenate(found))))

    def links(block: Block) -> Iterator[pa.RecordBatch]:
        node, raw = block.rows.column("node"), block.rows.column("text")
        out: list[tuple[bytes, bytes]] = []
        for start, end in pairwise(block.edge):
            parent = {c: c for c in block.component[start:end].tolist()}

            def root(c: int, parent=parent) -> int:
                while parent[c] != c:
                    parent[c] = parent[parent[c]]
                    c = parent[c]
                return c

            hashes: dict[int, np.ndarray] = {}
            held = 0
            for x, y in zip(*(k.tolist() for k in block.close(start, end, threshold, most)), strict=True):
                p, q = root(int(block.component[x])), root(int(block.component[y]))
                if p == q:
                    continue
                if held > 2_000_000:
                    hashes.clear()
                    held = 0
                for k in (x, y):
                    if k not in hashes:
                        hashes[k] = shingle_hashes(raw[k].as_py(), shingle)
                        held += len(hashes[k])
                # The sets' 64-bit hashes dismiss most pairs; the shingles themselves confirm.
                shared = len(np.intersect1d(hashes[x], hashes[y], assume_unique=True))
                if 100 * shared < percent * (len(hashes[x]) + len(hashes[y]) - shared):
                    continue
                if reaches(*(shingle_set(raw[k].as_py(), shingle) for k in (x, y)), percent):
                    parent[p] = q
                    out.append(tuple(sorted((node[x].as_py(), node[y].as_py()))))
        a, b = ([r[k] for r in out] for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    def dealt(rows: DataFrame, work, schema) -> DataFrame:
        # Many small blocks: dealt and sorted once, they cost a call each rather than a group of Spark's.
        rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        return rows.mapInArrow(by_blocks(work), schema)

    near = staged(dealt(members, plausible_members, members.schema), "plausible")
    return dealt(near.join(texts, "node"), links, "a binary, b binary").distinct()


def group(
    docs: DataFrame, shingle: int = 5, threshold: float = 0.8, bands: int = 40, rows: int = 6, block: int = 1024
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, content (a hash of the text) and component (a digest
    that names the group, null without shingles) of every row.

    Words are whitespace-delimited, A-Z lower-cased; a text of fewer words than shingle is one
    shingle. Rows whose texts have one shingle set, or sets of the threshold's similarity, are
    linked; component_id is the smallest doc_id reachable and kept marks the row that bears it
    (rows that repeat that id are all marked). A null or blank text has no shingle and is linked
    with nothing: its component is its own id. Null ids are no component's name unless all are null.
    """
    texts = columns_of(docs, "doc_id", "text")
    prints = fingerprints(texts, shingle, bands, rows)
    samples = bands * rows
    classes = staged(
        prints.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content", "n_shingles", "keys", "sketch")).alias("x"))
        .select("node", "x.doc_id", "x.content", "x.n_shingles", "x.keys", "x.sketch"),
        "classes",
    )
    buckets = shared_buckets(classes)
    bodies = texts_of(buckets.select("node").distinct(), texts, classes)

    def checked(pairs: DataFrame) -> DataFrame:
        return staged(confirmed(plausible(pairs, classes, threshold, samples), bodies, shingle, threshold), "links")

    links = checked(leader_pairs(buckets))
    labels = components(links)
    for more in (
        lambda: checked(component_pairs(buckets, labels)),
        lambda: staged(remaining_links(buckets, classes, labels, bodies, shingle, threshold, samples, block), "links"),
    ):
        found = more()
        if not found.isEmpty():
            links = links.union(found)
            labels = components(links)
    # Classes, then components, by partial minima; a hot class or component is one row of either.
    members = classes.select("node", "doc_id").join(labels, "node", "left")
    members = staged(members.select("node", "doc_id", F.coalesce("component", "node").alias("component")), "members")
    least = members.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = members.join(least, "component").select("node", "component", "component_id")
    with_set = prints.where(F.col("node").isNotNull()).join(named, "node")
    without = prints.where(F.col("node").isNull()).withColumns({"component_id": F.col("doc_id"), "component": F.col("node")})
    columns = ["doc_id", "content", "n_shingles", "component_id", "component"]
    return (
        with_set.select(*columns)
        .union(without.select(*columns))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def drop_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group, all columns as they are: the one with the smallest id, and
    of rows that repeat that id the first by a hash of the text. Rows without a shingle all stay."""
    names = docs.columns
    same, content, mark, rows = (unused(names, n) for n in ("same_id", "content", "content_", "rows_"))
    found = group(docs, **options).where(F.col("component").isNotNull())
    alike = found.groupBy("component", "doc_id", "content").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content", "rows"))
    keep = alike.groupBy("component").agg(first.alias("x"))
    keep = staged(
        keep.select(F.col("x.doc_id").alias(same), F.col("x.content").alias(content), F.col("x.rows").alias(rows)), "keep"
    )
    blank = F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    filled = docs.where(~blank).withColumn(mark, F.xxhash64("text"))
    kept = filled.join(keep, filled["doc_id"].eqNullSafe(keep[same]) & (filled[mark] == keep[content]))
    out = kept.where(F.col(rows) == 1).select(*quoted(names))
    if not keep.where(F.col(rows) > 1).isEmpty():  # one row of those that repeat id and text
        out = out.unionByName(kept.where(F.col(rows) > 1).dropDuplicates(["doc_id", mark]).select(*quoted(names)))
    return out.unionByName(docs.where(blank))
