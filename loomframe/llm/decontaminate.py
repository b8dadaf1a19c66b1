"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive benchmark words, grouped by length, with one searcher a length.
A searcher looks at the block of words that ends a candidate position: its shift table says how far
the next possible end is, blocks that end a pattern (shift 0) select a bucket of test windows, and
direct comparison confirms an occurrence.

A window is held as its place in the test's words, so a searcher takes some 40 bytes for each word.
"""

from __future__ import annotations

import uuid
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.llm._common import ALNUM_TABLE, LOWER, UPPER, columns_of, filter_bytes, map_bytes, quoted, staged, unused

#: Java pattern of a word, once A-Z are lower-cased.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LONG = (1 << 64) - 1


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(ALNUM_TABLE).split() if raw else []


class WuManber:
    """Of all windows of length words in the given (words, value) pairs."""

    def __init__(self, tests: list[tuple[list[bytes], object]], length: int, block: int = 3):
        self.length = length
        self.block = block = min(block, length)
        self.default = min(length - block + 1, 255)
        self.tests = tests
        blocks = sum(len(words) - block + 1 for words, _ in tests)
        self.mask = (1 << min(24, max(12, (8 * blocks).bit_length()))) - 1
        self.shift = shift = bytearray([self.default]) * (self.mask + 1)
        hashes, places = array("Q"), array("Q")
        for t, (words, _) in enumerate(tests):
            for end in range(block, len(words) + 1):
                key = hash(tuple(words[end - block : end]))
                spot = key & self.mask
                shift[spot] = min(shift[spot], max(0, length - end))
                if end >= length:
                    hashes.append(key & _LONG)
                    places.append(t << 32 | end - length)
        order = np.argsort(np.frombuffer(hashes, np.uint64), kind="stable") if hashes else np.zeros(0, int)
        # Sorted hashes of the blocks that end a window, and the windows' places: a bucket is a run of them.
        self.hashes = array("Q", np.frombuffer(hashes, np.uint64)[order].tobytes()) if hashes else hashes
        self.places = array("Q", np.frombuffer(places, np.uint64)[order].tobytes()) if places else places

    def find(self, words: list[bytes]):
        """(start, value) of every occurrence, overlapping ones too."""
        block, length, mask, shift, hashes, places, tests = (
            self.block, self.length, self.mask, self.shift, self.hashes, self.places, self.tests
        )
        end, n = length, len(words)
        while end <= n:
            key = hash(tuple(words[end - block : end]))
            step = shift[key & mask]
            if step:
                end += step
                continue
            at, key = end - length, key & _LONG
            i = bisect_left(hashes, key)
            while i < len(hashes) and hashes[i] == key:
                test, start = tests[places[i] >> 32], places[i] & 0xFFFFFFFF
                if test[0][start] == words[at] and test[0][start : start + length] == words[at:end]:
                    yield at, test[1]
                i += 1
            end += 1


def searchers_of(items: list[tuple], window: int, block: int = 3) -> list[WuManber]:
    """For (item, text) pairs; an item of fewer words than window is one pattern."""
    known: dict[bytes, bytes] = {}  # each word once
    by_length: dict[int, list] = {}
    for item, raw in items:
        if words := words_of(raw):
            by_length.setdefault(min(window, len(words)), []).append(([known.setdefault(w, w) for w in words], item))
    return [WuManber(tests, length, block) for length, tests in sorted(by_length.items())]


_searchers: dict[tuple, list[WuManber]] = {}


def _searchers_of(broadcast, window: int, block: int) -> list[WuManber]:
    """Built once in a Python worker, from the broadcast items."""
    key = (broadcast.value[0], window, block)
    if key not in _searchers:
        _searchers.clear()
        _searchers[key] = searchers_of(broadcast.value[1], window, block)
    return _searchers[key]


def search(searchers: list[WuManber], words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
    """Disjoint word spans that occurrences cover, in order, and the items they come from."""
    spans, items = [], set()
    for s in searchers:
        for at, value in s.find(words):
            spans.append((at, at + s.length))
            items.add(value)
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged, items


def benchmark_chunks(benchmark: DataFrame, most_bytes: int) -> Iterator[list[tuple]]:
    """Items in chunks of at most about most_bytes of text (a longer item is a chunk of its own), which
    stream through the driver: it holds the one that is being filled."""
    chunk: list[tuple] = []
    held = 0
    items = columns_of(benchmark, "item_id", "text").where(F.col("text").isNotNull())
    for item, raw in items.select("item_id", F.col("text").cast("binary")).toLocalIterator():
        if chunk and held + len(raw) > most_bytes:
            yield chunk
            chunk, held = [], 0
        chunk.append((item, bytes(raw)))
        held += len(raw)
    yield chunk


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, block: int = 3, chunk_bytes: int = 4 << 20
) -> DataFrame:
    """docs' doc_id, n_words, spans (disjoint word ranges that occurrences cover) and items (ids as
    strings, sorted) of every row.

    Null texts have no words and null or empty items no window. Items with a null id are searched
    and carry no id. Repeated rows are searched each. A benchmark over chunk_bytes is searched in
    as many passes over docs as it has chunks. What a pass finds goes by id and a hash of the text,
    not by place, so that it does not matter in what order a pass meets the rows.
    """
    rows = columns_of(docs, "doc_id", "text")
    chunks = benchmark_chunks(benchmark, chunk_bytes)
    first, second = next(chunks), next(chunks, None)
    sc = docs.sparkSession.sparkContext
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(span)),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
    if second is None:
        return _one_pass(rows, sc.broadcast((uuid.uuid4().hex, first)), window, block, fields)
    marked = rows.withColumn("content", F.xxhash64("text"))
    parts = []
    for chunk in _joined((first, second), chunks):
        shared = sc.broadcast((uuid.uuid4().hex, chunk))
        hits = _one_pass(marked, shared, window, block, fields).where(F.size("spans") > 0)
        parts.append(staged(hits.dropDuplicates(["doc_id", "content"]).drop("n_words"), "leaks"))
        shared.destroy()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    joined = every.groupBy(F.col("doc_id").alias("same_id"), F.col("content").alias("same")).agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    merged = F.aggregate(
        "spans",
        F.array().cast(fields[1].dataType),
        lambda done, s: F.when(
            (F.size(done) > 0) & (s["start"] <= F.element_at(done, -1)["end"]),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    n_words = F.coalesce(F.regexp_count(F.translate("text", UPPER, LOWER), F.lit(ALNUM_WORD)), F.lit(0)).cast("long")
    counted = marked.select("doc_id", "content", n_words.alias("n_words"))
    same = counted["doc_id"].eqNullSafe(joined["same_id"]) & counted["content"].eqNullSafe(joined["same"])
    return counted.join(joined, same, "left").select(
        "doc_id", "n_words",
        F.coalesce(merged, F.array().cast(fields[1].dataType)).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _joined(first: tuple, rest: Iterator) -> Iterator:
    yield from first
    yield from rest


def _one_pass(rows: DataFrame, items, window: int, block: int, fields: list) -> DataFrame:
    schema = T.StructType([*rows.drop("text").schema.fields, *fields])

    def run(others: dict, texts: list[bytes | None]) -> dict:
        searchers = _searchers_of(items, window, block)
        counts, spans, found = [], [], []
        for raw in texts:
            words = words_of(raw)
            merged, ids = search(searchers, words)
            counts.append(len(words))
            spans.append([{"start": a, "end": b} for a, b in merged])
            found.append(sorted(str(i) for i in ids if i is not None))
        return others | {"n_words": counts, "spans": spans, "items": found}

    return map_bytes(rows, run, schema)


def digest(leaks: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, from find_leaks()."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return leaks.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, block: int = 3, chunk_bytes: int = 4 << 20
) -> DataFrame:
    """docs without the rows that hold a benchmark window; all columns stay. Rows are judged where they
    lie, without a shuffle; those of a benchmark over chunk_bytes by the leaks of find_leaks. Rows of
    null or empty text stay."""
    chunks = benchmark_chunks(benchmark, chunk_bytes)
    first, second = next(chunks), next(chunks, None)
    if second is None:
        items = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, first))

        def clean(texts: list[bytes | None]) -> list[bool]:
            searchers = _searchers_of(items, window, block)
            return [not any(next(s.find(words_of(t)), None) for s in searchers) for t in texts]

        return filter_bytes(docs, clean)
    same, content, mark = (unused(docs.columns, n) for n in ("same_id", "content", "content_"))
    texts = columns_of(docs, "doc_id", "text")
    leaks = find_leaks(texts.withColumn("doc_id", F.struct("doc_id", F.xxhash64("text").alias("content"))), benchmark, window, block, chunk_bytes)
    bad = leaks.where(F.size("spans") > 0).select(F.col("doc_id.doc_id").alias(same), F.col("doc_id.content").alias(content))
    bad = staged(bad.distinct(), "leaks")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    out = marked.join(bad, marked["doc_id"].eqNullSafe(bad[same]) & (marked[mark] == bad[content]), "left_anti")
    return out.select(*quoted(docs.columns))
