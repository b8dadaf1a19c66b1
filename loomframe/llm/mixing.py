"""Mixing sources to target weights, with DataFrame operations only.

Each source's documents, in a fixed order, are one stream of tokens that is packed into blocks of
block_tokens. The mix is a sequence of output shards of shard_slots slots. A shard draws how many of
its slots go to each source from a multinomial over the sources' quotas (their targets in blocks): each
slot draws one of all slots' tickets, of which a source owns as many as its quota. A source's slots,
counted through all shards, map to its blocks by a pseudorandom permutation of the block numbers, a
new one for each pass over the source, and blocks join slots by (source, block).

Draws past a source's quota are handed, slot by slot, to sources whose draws fell short, so that a
source takes its target to within a block and no document is taken more often than max_passes.

Sources may be as many as documents: sizes, targets and quotas are a table, numbered in the sources'
order, and met by joins. The driver sees sums only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomframe.llm._common import SPACE_WORD, columns_of, staged

ROUNDS = 24


def uniform(*parts: Column) -> Column:
    """In [0, 1), from a hash of parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def permuted(index: Column, size: Column, *seed: Column) -> Column:
    """index in [0, size) through a pseudorandom permutation of that range: swap-or-not rounds, each
    of which pairs x with (k - x) mod size and swaps the pair or not, by a hash of its larger."""

    def swap(x: Column, r: Column) -> Column:
        # Keys differ in each round; the pair's larger member decides for both.
        other = F.pmod(F.pmod(F.xxhash64(r, *seed), size) + size - x, size)
        return F.when(F.pmod(F.xxhash64(F.greatest(x, other), r, *seed), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), swap)


def sized(docs: DataFrame) -> DataFrame:
    """Staged: doc_id, source, content (hash of the text) and size (in words) of every row."""
    rows = columns_of(docs, "doc_id", "source", "text")
    count = F.coalesce(F.regexp_count("text", F.lit(SPACE_WORD)), F.lit(0)).cast("long")
    return staged(rows.select("doc_id", "source", F.xxhash64("text").alias("content"), count.alias("size")), "sizes")


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """Staged: source, tokens, rows, part and s, its number from 0 by code points, a null last. part is
    a range of that order, of some ten thousand sources."""
    found = staged(sizes.groupBy("source").agg(F.sum("size").alias("tokens"), F.count("*").alias("rows")), "sources")
    parts = 1 + found.count() // 20_000
    ordered = found.withColumn("none", F.col("source").isNull()).repartitionByRange(parts, "none", "source")
    ordered = staged(ordered.withColumn("part", F.spark_partition_id()), "sources")
    place = Window.partitionBy("part").orderBy("none", "source")
    return staged(with_sums(ordered.withColumn("one", F.lit(1).cast("long")), place, one="s").drop("one", "none"), "sources")


def with_sums(table: DataFrame, place, **of: str) -> DataFrame:
    """table with, for each column named, its sum over all earlier rows: of those of the same part, in
    the window's order, and of all earlier parts."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = table.groupBy("part").agg(*[F.sum(n).alias(n) for n in of])
    first = parts.select("part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"first_{n}") for n in of])
    inside = place.rowsBetween(Window.unboundedPreceding, -1)
    run = table.select("*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"inside_{n}") for n in of])
    joined = run.join(first, "part")
    sums = [(F.col(f"first_{n}") + F.col(f"inside_{n}")).alias(name) for n, name in of.items()]
    return joined.select(*table.columns, *sums)


def with_weights(sources: DataFrame, weights: dict | None, cycle: tuple[float, ...]) -> DataFrame:
    """sources with weight: what weights says, or cycle over and over in their order."""
    if weights is None:
        return sources.withColumn("weight", F.get(F.array(*map(F.lit, cycle)), F.pmod("s", F.lit(len(cycle))).cast("int")))
    given = sources.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "named string, weight double")
    out = sources.join(given, sources["source"].eqNullSafe(given["named"]), "left").drop("named")
    if not out.where(F.col("weight").isNull()).isEmpty():
        raise ValueError("a source has no weight")
    return out


def with_targets(sources: DataFrame, max_passes: float) -> DataFrame:
    """sources with target: all tokens by weight, at most max_passes times the source's own, the excess
    by weight to those below, until none is above. A round is a sum over the sources."""
    most, tokens, weight = F.col("tokens") * float(max_passes), F.sum("tokens"), F.sum("weight")
    total, weights = sources.agg(tokens, weight).first()
    left, open_weight, full = float(total or 0), float(weights or 0), None
    while True:
        share = F.col("weight") * left / open_weight if open_weight else F.lit(0.0)
        above = share > most
        n, taken, kept = sources.where(above).agg(F.count("*"), F.sum(most), F.sum("weight")).first()
        if n == full or not n:
            return sources.withColumn("target", F.when(above, most).otherwise(share))
        full, left, open_weight = n, float(total) - taken, float(weights) - kept


def with_quotas(sources: DataFrame, block_tokens: int, max_passes: int) -> DataFrame:
    """Staged: sources with blocks, quota (slots: one is worth the source's mean block) and first, the
    slots of all sources before."""
    blocks = F.ceil(F.col("tokens") / block_tokens)
    slots = F.least(F.round(F.col("target") * F.col("blocks") / F.nullif(F.col("tokens"), F.lit(0))).cast("long"), max_passes * F.col("blocks"))
    sized = sources.withColumn("blocks", blocks).withColumn("quota", F.when(F.col("tokens") > 0, slots).otherwise(F.lit(0)))
    return staged(with_sums(sized, Window.partitionBy("part").orderBy("s"), quota="first"), "quotas")


def packed(sizes: DataFrame, sources: DataFrame, lanes: int) -> DataFrame:
    """doc_id, source, content, size, s, source_size, target and start, the offset of each row in its
    source's stream, ordered by a hash lane, then id and text. A lane is a bounded share of a source, so
    no task sorts a whole source, and what is known of a source meets its rows lane by lane."""
    lane = F.pmod(F.xxhash64(F.lit("lane"), "doc_id", "content"), F.lit(lanes))
    laned = sizes.withColumn("lane", lane)
    sums = laned.groupBy("source", "lane").agg(F.sum("size").alias("tokens"))
    before = Window.partitionBy("source").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "lane", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("offset"))
    known = sources.select(F.col("source").alias("of"), "s", F.col("tokens").alias("source_size"), "target")
    offsets = offsets.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    inside = Window.partitionBy("source", "lane").orderBy("doc_id", "content").rowsBetween(Window.unboundedPreceding, -1)
    run = laned.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return run.alias("r").join(
        offsets.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.lane") == F.col("o.lane"))
    ).select(
        "doc_id", F.col("r.source").alias("source"), "content", "size", "s", "source_size", "target",
        (F.col("inside") + F.col("offset")).alias("start"),
    )


def pieces(rows: DataFrame, block_tokens: int) -> DataFrame:
    """A row for each block that a (non-empty) row of packed() reaches into: block, first and last+1
    position in the stream."""
    width = F.lit(block_tokens)
    first, last = F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("size") - 1) / width)
    return rows.where(F.col("size") > 0).withColumn("block", F.explode(F.sequence(first, last))).withColumns(
        {
            "at": F.greatest(F.col("start"), F.col("block") * width),
            "end": F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * width),
        }
    )


def owners(rows: DataFrame, at: str, table: DataFrame, first: str, size: str, total: int, kinds: int) -> DataFrame:
    """rows with the columns of the table's row whose range, size numbers from first on, holds the
    number at. An equi-join on spans of numbers, of which there are about four for each of kinds ranges;
    so a wide range is met in many spans, and a span meets at most as many ranges as it has numbers."""
    width = max(1, total // (4 * max(1, kinds)))
    span = F.explode(F.sequence(F.floor(F.col(first) / width), F.floor((F.col(first) + F.col(size) - 1) / width)))
    spread = table.where(F.col(size) > 0).withColumn("span", span)
    inside = (F.col(at) >= F.col(first)) & (F.col(at) < F.col(first) + F.col(size))
    return rows.withColumn("span", F.floor(F.col(at) / width)).join(spread, "span").where(inside).drop("span")


def draws(sources: DataFrame, shard_slots: int, seed: int, run_shards: int = 4096) -> DataFrame:
    """shard, slot, s, blocks, turn: the mix's slots. turn counts a source's slots through all shards,
    by runs of run_shards of them, so no task orders all of a source's."""
    spark = sources.sparkSession
    total, kinds = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    ticket = F.floor(uniform(F.lit(seed), F.col("shard"), F.col("slot")) * total)
    slots = spark.range(0, total, 1, max(1, min(4096, -(-total // 200_000)))).select(
        F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod("id", F.lit(shard_slots)).alias("slot")
    )
    drawn = owners(slots.withColumn("ticket", ticket), "ticket", sources.select("s", "first", "quota"), "first", "quota", total, kinds)
    # The multinomial counts of each shard, with the slots that drew: at most shard_slots in a row.
    counts = drawn.groupBy("s", "shard").agg(F.array_sort(F.collect_list("slot")).alias("slots"))
    counts = staged(counts.select("s", "shard", F.floor(F.col("shard") / run_shards).alias("run"), "slots"), "draws")
    n = F.size("slots").cast("long")
    runs = counts.groupBy("s", "run").agg(F.sum(n).alias("n"))
    earlier = Window.partitionBy("s").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("s", "run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offset = runs.select("s", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    placed = counts.withColumn("inside", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(offset, ["s", "run"])

    # Draws past a quota, in order, take the turns that other sources have left.
    met = runs.groupBy("s").agg(F.sum("n").alias("n")).withColumnRenamed("s", "of")
    balance = sources.join(met, F.col("s") == F.col("of"), "left").withColumn("drawn", F.coalesce("n", F.lit(0)))
    balance = balance.select(
        "s", "part", "quota", "blocks", "drawn",
        F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)).alias("over"),
        F.greatest(F.col("quota") - F.col("drawn"), F.lit(0)).alias("lack"),
    )
    order = Window.partitionBy("part").orderBy("s")
    balance = staged(with_sums(balance, order, over="over_first", lack="lack_first").drop("part"), "balance")
    moved, gaps = balance.agg(F.coalesce(F.sum("lack"), F.lit(0)), F.sum((F.col("lack") > 0).cast("long"))).first()
    # What is known of a source meets its draws run by run: at most a row of it for each.
    known = runs.select("s", "run").join(balance.select("s", "quota", "blocks", "over_first"), "s")
    turns = placed.join(known, ["s", "run"]).select(
        "shard", "s", "quota", "blocks", "over_first", "offset", "inside", F.posexplode("slots").alias("pos", "slot")
    )
    turns = turns.withColumn("turn", F.col("offset") + F.col("inside") + F.col("pos"))
    kept = turns.where(F.col("turn") < F.col("quota")).select("shard", "slot", "s", "blocks", "turn")
    over = turns.where(F.col("turn") >= F.col("quota"))
    over = over.select("shard", "slot", (F.col("over_first") + F.col("turn") - F.col("quota")).alias("rank"))
    gap = balance.select("s", "blocks", "drawn", "lack", "lack_first")
    taken_over = owners(over, "rank", gap, "lack_first", "lack", moved, gaps or 0)
    turn = (F.col("rank") - F.col("lack_first") + F.col("drawn")).alias("turn")
    return kept.unionByName(taken_over.select("shard", "slot", "s", "blocks", turn))


def mix_plan(
    docs: DataFrame,
    weights: dict | None = None,
    cycle: tuple[float, ...] = (5.0, 2.0, 1.0),
    block_tokens: int = 256,
    shard_slots: int = 1024,
    max_passes: int = 3,
    seed: int = 20,
) -> tuple[DataFrame, DataFrame]:
    """(packed rows; shard, slot, s, block, pass: the slots with their blocks)."""
    sizes = sized(docs)
    sources = with_weights(numbered_sources(sizes), weights, cycle)
    sources = with_quotas(with_targets(sources, max_passes), block_tokens, max_passes)
    # About 5000 rows a lane in the largest source, and enough lanes to deal small ones out.
    most = sources.agg(F.coalesce(F.max("rows"), F.lit(0))).first()[0]
    rows = packed(sizes, sources, max(256, most // 5000))
    turn, size = F.col("turn"), F.col("blocks")
    round_ = F.floor(turn / size)
    block = permuted(F.pmod(turn, size), size, F.lit(seed), F.col("s"), round_)
    drawn = draws(sources, shard_slots, seed)
    # The permutation is the costly part of a slot: dealt out by number, not by the few bytes of a slot.
    n = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    drawn = drawn.repartition(max(1, min(20_000, -(-n // 20_000))), "shard", "slot")
    return rows, drawn.select("shard", "slot", "s", block.alias("block"), round_.alias("pass"))


def taken(docs: DataFrame, block_tokens: int = 256, **options) -> DataFrame:
    """doc_id, size, source_size, target (of its source) and taken (words that the mix takes of it,
    repeats counted) of every row.

    A null text has size 0, and a row of size 0 takes 0. A null source is a source of its own, the
    last. Repeated rows each have their own place in the stream. The same rows give the same mix.
    """
    rows, slots = mix_plan(docs, block_tokens=block_tokens, **options)
    times = slots.groupBy("s", "block").agg(F.count("*").alias("times"))
    used = (
        pieces(rows, block_tokens)
        .join(times, ["s", "block"])
        .groupBy("s", "start", "size")
        .agg(F.sum((F.col("end") - F.col("at")) * F.col("times")).alias("taken"))
    )
    names = ["doc_id", "size", "source_size", "target"]
    whole = rows.where(F.col("size") > 0).join(used.drop("size"), ["s", "start"], "left")
    empty = rows.where(F.col("size") == 0).withColumn("taken", F.lit(0))
    cut = [F.coalesce("taken", F.lit(0)).cast("long").alias("taken")]
    return whole.select(*names, *cut).unionByName(empty.select(*names, *cut))


def mixed_blocks(docs: DataFrame, block_tokens: int = 256, **options) -> DataFrame:
    """shard, slot, source, block, pass, doc_ids, n_tokens and text of every slot of the mix: its
    block's words joined by blanks, and the documents that they come from, in stream order. The
    last block of a source may be short. Deterministic; empty for documents without a word."""
    rows, slots = mix_plan(docs, block_tokens=block_tokens, **options)
    texts = columns_of(docs, "doc_id", "source", "text").withColumn("content", F.xxhash64("text"))
    texts = texts.where(F.regexp_like("text", F.lit(SPACE_WORD)))
    placed = rows.where(F.col("size") > 0)
    same = ("doc_id", "source", "content")
    if not placed.groupBy(*same).count().where(F.col("count") > 1).isEmpty():
        texts = texts.dropDuplicates(list(same))  # rows alike in all three have one text, and places of their own
    joined = placed.alias("p").join(
        texts.alias("t"),
        F.col("p.doc_id").eqNullSafe(F.col("t.doc_id"))
        & F.col("p.source").eqNullSafe(F.col("t.source"))
        & (F.col("p.content") == F.col("t.content")),
    ).select("p.doc_id", "p.source", "s", "start", "size", F.regexp_extract_all("text", F.lit(SPACE_WORD), F.lit(0)).alias("words"))
    cut = pieces(joined, block_tokens).select(
        "s", "source", "block", "at", "doc_id",
        F.array_join(F.slice("words", (F.col("at") - F.col("start") + 1).cast("int"), (F.col("end") - F.col("at")).cast("int")), " ").alias("text"),
        (F.col("end") - F.col("at")).alias("n"),
    )
    blocks = cut.groupBy("s", "block").agg(
        F.first("source").alias("source"),
        F.array_sort(F.collect_list(F.struct("at", "doc_id", "text"))).alias("parts"),
        F.sum("n").alias("n_tokens"),
    )
    return slots.join(blocks, ["s", "block"]).select(
        "shard", "slot", "source", "block", "pass", F.col("parts.doc_id").alias("doc_ids"), "n_tokens", F.array_join("parts.text", " ").alias("text")
    )
