"""Language-model scoring by prediction by partial matching (PPM) over bytes.

Counts of byte contexts of order 4 and below form a trie. A symbol is coded in the longest known
context; a symbol that it has not seen escapes (method C: as often as the context has distinct
symbols) to the next shorter one, where the symbols already excluded no longer count. The trie is
trained on the whole training fold, and as it is fixed while scoring, the code length of each
(context, symbol) is worked out once; a text's code length is a sum of table look-ups. The contexts of
orders 3 and 4 that are met most are looked up in a broadcast table, all others meet theirs in a join:
what a context's code takes more than that of the next shorter one is added to the latter.

Beside it stands a unigram baseline with add-one smoothing, from exact counts of all words. It is no
probability of the text: it codes no blanks, and gives every unknown word, however long, the same share.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.llm._common import columns_of, id_remainder, map_bytes, staged

ORDER = 4
#: Before a text, and once after it as its end.
PAD = b"\0" * ORDER
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
WORD, GRAM, TEXTS = 0, 1, 2


def packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased texts with their pads in one buffer; first and last+1 position to code."""
    buffer = _LOWER[np.frombuffer(PAD + (b"\0" + PAD).join(texts) + b"\0", np.uint8)]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + ORDER)[:-1]]) + ORDER
    return buffer, starts, starts + sizes


def contexts(buffer: np.ndarray) -> np.ndarray:
    """At position i >= 4, the four bytes before it in 32 bits; the last three in the lower 24."""
    out = buffer[:-4].astype(np.int64)
    for i in range(1, 4):
        out <<= 8
        out |= buffer[i : i - 4]
    return out


def gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (context, symbol) in 40 bits, and how often each was coded."""
    buffer, starts, ends = packed(texts)
    grams = contexts(buffer)
    grams <<= 8
    grams |= buffer[ORDER:]
    coded = np.zeros(len(buffer) + 1, np.int8)
    coded[starts] += 1
    coded[ends] -= 1
    return np.unique(grams[np.cumsum(coded[:-1], dtype=np.int8)[ORDER:].astype(bool)], return_counts=True)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of parts (keys, counts), and the sums of their counts."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def lists(offsets, **columns: pa.Array) -> pa.ListArray:
    """Structs of the columns, those from one offset to the next in a list. Python objects made of
    each would take some ten times the memory."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def corpus_counts(train: DataFrame, flush: int = 300_000) -> DataFrame:
    """kind, key, n over all of train's texts: words, (context, symbol) grams and the texts. Each
    task sums its own before the shuffle and lets go of what it holds at flush distinct words."""
    schema = T.StructType(
        [T.StructField("kind", T.IntegerType()), T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType())]
    )

    def run(batches):
        from loomframe.llm._common import split_batch

        words: Counter = Counter()
        grams = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        texts_seen = 0

        def out():
            g, n = summed(grams)
            five = np.ascontiguousarray(g.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 3:])
            packed_grams = pa.FixedSizeBinaryArray.from_buffers(pa.binary(5), len(g), [None, pa.py_buffer(five)])
            keys = [pa.array(list(words), pa.binary()), packed_grams.cast(pa.binary()), pa.array([b""], pa.binary())]
            kinds = np.repeat(np.array([WORD, GRAM, TEXTS], np.int32), [len(words), len(g), 1])
            counts = [pa.array(list(words.values()), pa.int64()), pa.array(n), pa.array([texts_seen], pa.int64())]
            arrow = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("n", pa.int64())])
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.concat_arrays(keys), pa.concat_arrays(counts)], schema=arrow)

        for batch in batches:
            for _, texts in split_batch(batch, "text", 1 << 20):
                texts = [t or b"" for t in texts]
                texts_seen += len(texts)
                for t in texts:
                    words.update(t.lower().split())
                grams.append(gram_counts(texts))
                if len(words) + sum(len(k) for k, _ in grams) > flush:
                    grams[:] = [summed(grams)]
                if len(words) + sum(len(k) for k, _ in grams) > flush:
                    yield out()
                    words.clear()
                    grams[:] = [tuple(x[:0] for x in grams[0])]
                    texts_seen = 0
        yield out()

    return train.select("text").mapInArrow(run, schema).groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Trie:
    """Code lengths in bits for the given contexts, dense over the symbols seen.

    keys4, n4: (context, symbol) and count of order 4; keys3, n3: of order 3; keys2, n2: the same of
    order 2, complete. The contexts of keys4 end in one of keys3. known3: a bit for each of the 2**24
    contexts of order 3, whether training met it; known4: for each context of keys3, in order, and each
    byte before it, whether that context of order 4 was met. Those met but not in keys3 or keys4 are
    coded from the next shorter one here, and told as missed.
    """

    def __init__(self, keys4, n4, keys3, n3, keys2, n2, known3: np.ndarray, known4: np.ndarray):
        self.key = uuid.uuid4().hex
        self.known3, self.known4 = known3, known4
        seen = np.unique(keys2 & 255)
        #: Symbol -> column; the last column is for a symbol never seen.
        self.column = np.full(256, len(seen), np.int32)
        self.column[seen] = np.arange(len(seen))
        width = len(seen) + 1
        self.nodes4, self.nodes3 = np.unique(keys4 >> 8), np.unique(keys3 >> 8)
        nodes2 = np.unique(keys2 >> 8)
        nodes1 = np.unique(nodes2 & 255)

        def matrix(keys, n, nodes):
            m = np.zeros((len(nodes), width))
            np.add.at(m, (np.searchsorted(nodes, keys >> 8), self.column[keys & 255]), n)
            return m

        def upper(keys, n, nodes, below, mask, parents, beyond) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Counts, bits and bits once escaped of contexts, some thousand at a time."""
            made = [(np.empty((0, width), np.float32),) * 3]
            cuts = np.searchsorted(keys >> 8, nodes[::4096]) if len(keys) else np.zeros(0, int)
            for i, at in enumerate(cuts):
                end = cuts[i + 1] if i + 1 < len(cuts) else len(keys)
                part = nodes[i * 4096 : (i + 1) * 4096]
                m = matrix(keys[at:end], n[at:end], part)
                after = self._after_escape(m, parents, np.searchsorted(below, part & mask), beyond)
                made.append(tuple(x.astype(np.float32) for x in (m, self._code(m, after), after)))
            return tuple(np.concatenate(x) for x in zip(*made, strict=True))

        m2 = matrix(keys2, n2, nodes2)
        m1 = np.zeros((len(nodes1), width))
        np.add.at(m1, np.searchsorted(nodes1, nodes2 & 255), m2)
        m0 = m1.sum(axis=0, keepdims=True)
        # Beyond order 0 the symbols left are equally likely.
        beyond0 = np.full((1, width), math.log2(max(1, 256 - len(seen))))
        row0 = self._code(m0, beyond0)
        beyond1 = self._after_escape(m1, m0, np.zeros(len(nodes1), int), beyond0)
        row1 = self._code(m1, beyond1)
        up2 = np.searchsorted(nodes1, nodes2 & 255)
        beyond2 = self._after_escape(m2, m1, up2, beyond1)
        row2 = self._code(m2, beyond2)
        self.met2 = m2 > 0
        m3, row3, beyond3 = upper(keys3, n3, self.nodes3, nodes2, 0xFFFF, m2, beyond2)
        row4 = upper(keys4, n4, self.nodes4, self.nodes3, 0xFFFFFF, m3, beyond3)[1]
        #: Rows: contexts of order 4, then of order 3, 2, 1 and 0.
        self.bits = np.concatenate([x.astype(np.float32) for x in (row4, row3, row2, row1, row0)])
        self.nodes2, self.nodes1 = nodes2, nodes1

    @staticmethod
    def _code(m: np.ndarray, beyond: np.ndarray) -> np.ndarray:
        """Bits of each symbol from a context with counts m; beyond: bits once escaped."""
        total = m.sum(axis=1, keepdims=True)
        kinds = (m > 0).sum(axis=1, keepdims=True)
        whole = np.log2(np.maximum(total + kinds, 1))
        return np.where(m > 0, whole - np.log2(np.maximum(m, 1)), whole - np.log2(np.maximum(kinds, 1)) + beyond)

    @staticmethod
    def _after_escape(m: np.ndarray, parents: np.ndarray, up: np.ndarray, beyond: np.ndarray) -> np.ndarray:
        """Bits after an escape from contexts m to their parents, without m's symbols."""
        p = np.where(m > 0, 0, parents[up])
        total = p.sum(axis=1, keepdims=True)
        kinds = (p > 0).sum(axis=1, keepdims=True)
        whole = np.log2(np.maximum(total + kinds, 1))
        escape = np.where(kinds > 0, whole - np.log2(np.maximum(kinds, 1)), 0)
        return np.where(p > 0, whole - np.log2(np.maximum(p, 1)), escape + beyond[up])

    def index(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where a context's row of bits is. First two bytes of a context of nodes3 -> where its page
        begins; there, by third byte, its row, -1 where nodes3 has no such context. Last two bytes -> the row of order
        2 or below. And for each context of nodes3 and column of the byte before it -> row of order 4;
        -1 if that context was not met, -2 if it is told as missed. A table of all 2**24 contexts would
        be 64 MB in each worker; the pages are at most as many as nodes3, of 1 KB each."""
        n4, n3, n2, n1 = len(self.nodes4), len(self.nodes3), len(self.nodes2), len(self.nodes1)
        by1 = np.full(256, n4 + n3 + n2 + n1, np.int32)
        by1[self.nodes1] = n4 + n3 + n2 + np.arange(n1)
        by2 = np.tile(by1, 256)
        by2[self.nodes2] = n4 + n3 + np.arange(n2)
        first2 = np.unique(self.nodes3 >> 8)
        page = np.zeros(1 << 16, np.int32)  # the first page is empty
        page[first2] = 256 * (1 + np.arange(len(first2)))
        pages = np.full(256 * (len(first2) + 1), -1, np.int32)
        pages[page[self.nodes3 >> 8] + (self.nodes3 & 255)] = n4 + np.arange(n3)
        known = np.flatnonzero(np.unpackbits(self.known4, bitorder="little")[: n3 * 256])
        by4 = np.full((n3, self.bits.shape[1]), -1, np.int32)
        by4[known >> 8, self.column[known & 255]] = -2
        by4[np.searchsorted(self.nodes3, self.nodes4 & 0xFFFFFF), self.column[self.nodes4 >> 24]] = np.arange(n4)
        return page, pages, by2, by4

    def code_lengths(self, texts: list[bytes], index: tuple[np.ndarray, ...]) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
        """Bits of each text with its end, and what each has of missed contexts of order 3 and of order
        4: the context, the symbol, how often it stands there, and for order 3 whether order 2 has met
        the symbol. Of order 4, contexts of which it is not known here whether training met them count."""
        buffer, starts, ends = packed(texts)
        page, pages, by2, by4 = index
        context, symbol = contexts(buffer), buffer[ORDER:]
        last3 = context & 0xFFFFFF
        rows = pages[page[last3 >> 8] + (last3 & 255)].astype(np.int64)
        n4, n3 = len(self.nodes4), len(self.nodes3)
        dense, shorter = np.flatnonzero(rows >= 0), np.flatnonzero(rows < 0)
        last3 = last3[shorter]
        rows[shorter] = by2[last3 & 0xFFFF]
        lost3 = np.zeros(len(rows), bool)
        lost3[shorter] = (self.known3[last3 >> 3] >> (last3 & 7)) & 1
        lost4 = lost3.copy()
        longer = by4[rows[dense] - n4, self.column[context[dense] >> 24]]
        lost4[dense[longer == -2]] = True
        rows[dense[longer >= 0]] = longer[longer >= 0]

        def told(at: np.ndarray, key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
            """The distinct keys (of so many bits) at the positions of each text, where each text's
            begin and the last one's end, and how often each key stands there."""
            text = np.searchsorted(starts - ORDER, at, "right") - 1
            inside = (text >= 0) & (at < ends[text] - ORDER)
            each, times = np.unique((text[inside] << bits) | key[inside], return_counts=True)
            return np.searchsorted(each >> bits, np.arange(len(texts) + 1)), each & ((1 << bits) - 1), pa.array(times, pa.int64())

        def byte(symbols: np.ndarray) -> pa.Array:
            return pa.array((symbols & 255).astype(np.int32))

        at = np.flatnonzero(lost3)
        met = self.met2[rows[at] - n4 - n3, self.column[symbol[at]]]
        key3 = ((context[at] & 0xFFFFFF) << 9) | (symbol[at].astype(np.int64) << 1) | met
        offsets, key, times = told(at, key3, 33)
        missed3 = lists(offsets, context=pa.array(key >> 9), symbol=byte(key >> 1), times=times, met2=pa.array((key & 1).astype(bool)))
        at = np.flatnonzero(lost4)
        offsets, key, times = told(at, (context[at] << 8) | symbol[at], 40)
        missed4 = lists(offsets, context=pa.array(key >> 8), symbol=byte(key), times=times)
        rows *= self.bits.shape[1]
        rows += self.column[symbol]
        bits = self.bits.ravel()[rows]
        cut = np.empty(2 * len(texts), np.int64)
        cut[0::2], cut[1::2] = starts - ORDER, ends - ORDER
        if cut[-1] == len(bits):
            cut = cut[:-1]
        return np.add.reduceat(bits, cut, dtype=np.float64)[0::2], missed3, missed4


def all_grams(counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """g and n of (context, symbol) grams, of order 4, 3 and 2."""
    grams = counts.where(F.col("kind") == GRAM).select(F.conv(F.hex("key"), 16, 10).cast("long").alias("g"), "n")
    lower = lambda mask: grams.groupBy(F.col("g").bitwiseAND(F.lit(mask)).alias("g")).agg(F.sum("n").alias("n"))
    return grams, lower(0xFFFFFFFF), lower(0xFFFFFF)


def bitmap(places: DataFrame, size: int) -> np.ndarray:
    """A bit for each number below size, set for those in the column place."""
    place = F.col("place") + 1  # buckets hold the values from 1 on
    buckets = places.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    known = np.zeros(-(-size // 32768) * 4096, np.uint8)
    for b, bits in buckets.collect():
        known[(b - 1) * 4096 : b * 4096] = np.frombuffer(bits, np.uint8)
    return known


def train_trie(counts: DataFrame, most_contexts: int) -> Trie:
    """The trie of order 2 (whole: at most 2**24 grams) and the most_contexts contexts of order 3 that
    are met most, and of order 4 of those that end in one of them. So the driver gets at most 2**24 +
    512 * most_contexts counts, and a bit for each context of order 3 and each byte before one of the
    former; all other contexts are for context_bits()."""
    grams4, grams3, grams2 = all_grams(counts)
    spark = counts.sparkSession

    def frequent(grams: DataFrame) -> DataFrame:
        named = grams.withColumn("c", F.shiftright("g", 8))
        met = named.groupBy("c").agg(F.sum("n").alias("met")).orderBy(F.desc("met"), "c").limit(most_contexts)
        return named.join(met.select("c"), "c", "left_semi").select("g", "n")

    def arrays(df):
        table = df.toArrow()
        keys = table.column("g").to_numpy().astype(np.int64)
        order = np.argsort(keys)
        return keys[order], table.column("n").to_numpy().astype(np.float64)[order]

    upper3 = arrays(frequent(grams3))
    nodes3 = np.unique(upper3[0] >> 8)
    # At most most_contexts rows of two numbers: a bounded broadcast.
    places = spark.createDataFrame(pa.table({"c3": pa.array(nodes3, pa.int64()), "row": pa.array(np.arange(len(nodes3)), pa.int64())}))
    ending = grams4.withColumn("c3", F.shiftright("g", 8).bitwiseAND(F.lit(0xFFFFFF))).join(F.broadcast(places), "c3")
    upper4 = arrays(frequent(ending.select("g", "n")))
    known3 = bitmap(grams3.select(F.shiftright("g", 8).alias("place")), 1 << 24)
    known4 = bitmap(ending.select((F.col("row") * 256 + F.shiftright("g", 32)).alias("place")), len(nodes3) * 256)
    return Trie(*upper4, *upper3, *arrays(grams2), known3, known4)


def context_bits(grams: DataFrame, lower: DataFrame, bits: int) -> DataFrame:
    """Of every context of grams: what a symbol's code takes more than from the next shorter context,
    whose grams (of so many bits) are lower. context, symbols (those the context has met, by symbol),
    and for the others after the escape, without the context's symbols: known if the shorter context has
    met the symbol, unknown if not; and shorter, the symbols that the shorter one has met."""
    mask = (1 << bits) - 1
    symbol = F.col("g").bitwiseAND(F.lit(255)).cast("int")
    below = lower.groupBy(F.shiftright("g", 8).alias("c2")).agg(F.sum("n").alias("t2"), F.count("*").alias("k2"), F.collect_list(symbol).alias("shorter"))
    whole2 = F.log2(F.col("t2") + F.col("k2"))
    lower = lower.select(F.col("g").alias("g2"), F.col("n").alias("n2"))
    each = grams.withColumn("g2", F.col("g").bitwiseAND(F.lit(mask))).join(lower, "g2")
    own = (
        each.groupBy(F.shiftright("g", 8).alias("context"))
        .agg(
            F.sum("n").alias("t3"),
            F.count("*").alias("k3"),
            F.sum("n2").alias("gone"),
            F.collect_list(F.struct(symbol.alias("s"), (F.log2("n2") - F.log2("n")).alias("more"))).alias("own"),
        )
        .withColumn("c2", F.col("context").bitwiseAND(F.lit(mask >> 8)))
        .join(below, "c2")
    )
    whole3 = F.log2(F.col("t3") + F.col("k3"))
    kinds = F.col("k2") - F.col("k3")
    left = F.log2(F.col("t2") - F.col("gone") + kinds)
    escape = whole3 - F.log2("k3")
    return own.select(
        "context",
        F.map_from_entries(F.transform("own", lambda x: F.struct(x["s"], whole3 - whole2 + x["more"]))).alias("symbols"),
        F.when(kinds > 0, escape + left - whole2).alias("known"),
        (escape + F.when(kinds > 0, left - F.log2(kinds)).otherwise(0.0) - whole2 + F.log2("k2")).alias("unknown"),
        "shorter",
    )


_indexes: dict[str, tuple[np.ndarray, ...]] = {}


def _index_of(trie: Trie) -> tuple[np.ndarray, ...]:
    if trie.key not in _indexes:
        _indexes.clear()
        _indexes[trie.key] = trie.index()
    return _indexes[trie.key]


def frequent_words(words: DataFrame, most: int) -> tuple[dict[bytes, float], int]:
    """The words counted at least least times, by log10(n + 1), and least: the smallest quarter
    power of two that leaves at most most words. The driver sees a histogram, then those words."""
    step = F.floor(F.log2("n") * 4).cast("int")
    histogram = {r[0]: r[1] for r in words.groupBy(step.alias("s")).count().collect()}
    held, cut = 0, max(histogram, default=0) + 1
    for s in sorted(histogram, reverse=True):
        if held + histogram[s] > most:
            break
        held, cut = held + histogram[s], s
    table = words.where(step >= cut).select("key", "n").toArrow()
    keys, n = table.column("key").to_pylist(), table.column("n").to_pylist()
    return {bytes(k): math.log10(c + 1) for k, c in zip(keys, n, strict=True)}, cut


def score_texts(
    docs: DataFrame, held_out: int = 2, folds: int = 7, table_words: int = 100_000, most_contexts: int = 30_000
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    base_score is the unigram baseline's log10 probability, score the PPM model's (of the whole
    lower-cased text and its end). Both learn from the rows whose crc32(doc_id) mod folds is not
    held_out; a null id is learnt from. A null text counts as empty: one token, its end. Words are
    looked up in a broadcast table of at most table_words frequent ones; all others meet their
    counts in a join by word. So are contexts in one of the most_contexts of order 3 and of order 4 met
    most; all others seen meet their code lengths in a join by context. With nothing to learn from both scores are those of empty models.
    """
    rows = columns_of(docs, "doc_id", "text").select(
        "doc_id", F.coalesce(id_remainder(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "text"
    )
    counts = staged(corpus_counts(rows.where(~F.col("held_out"))), "counts")
    words = counts.where(F.col("kind") == WORD).select("key", "n")
    tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = counts.where(F.col("kind") == TEXTS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, distinct = tokens + ends, kinds + (ends > 0)
    table, cut = frequent_words(words, table_words)
    trie = train_trie(counts, most_contexts)
    shared = docs.sparkSession.sparkContext.broadcast((table, trie))
    end_part = math.log10(ends + 1)

    missed = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("times", T.LongType())])
    in_context = T.StructType(
        [
            T.StructField("context", T.LongType()),
            T.StructField("symbol", T.IntegerType()),
            T.StructField("times", T.LongType()),
        ]
    )
    in_context3 = T.StructType([*in_context.fields, T.StructField("met2", T.BooleanType())])
    schema = T.StructType(
        [
            *rows.drop("text").schema.fields,
            T.StructField("row_id", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("known", T.LongType()),
            T.StructField("part", T.DoubleType()),
            T.StructField("bits", T.DoubleType()),
            T.StructField("missed", T.ArrayType(missed)),
            T.StructField("contexts3", T.ArrayType(in_context3)),
            T.StructField("contexts4", T.ArrayType(in_context)),
        ]
    )

    def run(others: dict, texts: list[bytes | None]) -> dict:
        table, trie = shared.value
        index = _index_of(trie)
        texts = [t or b"" for t in texts]
        n_tokens, known, part, keys, times, offsets = [], [], [], [], [], [0]
        for t in texts:
            tokens = t.lower().split()
            found = list(map(table.get, tokens))
            parts = [x for x in found if x is not None]
            n_tokens.append(len(tokens) + 1)
            known.append(len(parts) + (ends > 0))
            part.append(sum(parts) + end_part)
            rest = Counter(w for w, x in zip(tokens, found, strict=True) if x is None)
            keys += rest.keys()
            times += rest.values()
            offsets.append(len(keys))
        misses = lists(offsets, key=pa.array(keys, pa.binary()), times=pa.array(times, pa.int64()))
        bits, seldom3, seldom4, held, at = [], [], [], 0, 0
        for i, t in enumerate(texts):  # some 128 KB at a time, for the arrays of 8 bytes a position made of it
            held += len(t)
            if held > 1 << 17 or i + 1 == len(texts):
                more, missed3, missed4 = trie.code_lengths(texts[at : i + 1], index)
                bits += more.tolist()
                seldom3.append(missed3)
                seldom4.append(missed4)
                held, at = 0, i + 1
        seldom = {"contexts3": pa.concat_arrays(seldom3), "contexts4": pa.concat_arrays(seldom4)}
        return others | seldom | {"n_tokens": n_tokens, "known": known, "part": part, "bits": bits, "missed": misses}

    scored = staged(map_bytes(rows.withColumn("row_id", F.monotonically_increasing_id()), run, schema), "scored")
    seldom = words.where(F.floor(F.log2("n") * 4).cast("int") < cut)
    met = (
        scored.select("row_id", F.explode("missed").alias("m"))
        .select("row_id", "m.key", "m.times")
        .join(seldom, "key")
        .groupBy("row_id")
        .agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_part"))
    )
    grams4, grams3, grams2 = all_grams(counts)

    def coded(contexts: str, lengths: DataFrame, met: Column) -> DataFrame:
        """row_id and what its missed contexts of an order add."""
        more = F.coalesce(F.col("symbols")[F.col("symbol")], F.when(met, F.col("known")).otherwise(F.col("unknown")))
        missed = scored.select("row_id", F.explode(contexts).alias("m")).select("row_id", "m.*")
        return missed.join(lengths, "context").select("row_id", (F.col("times") * more).alias("more"))

    added = coded("contexts3", context_bits(grams3, grams2, 24).drop("shorter"), F.col("met2"))
    added = added.unionByName(coded("contexts4", context_bits(grams4, grams3, 32), F.array_contains("shorter", F.col("symbol"))))
    seldom_coded = added.groupBy("row_id").agg(F.sum("more").alias("more_bits"))
    return (
        scored.drop("missed", "contexts3", "contexts4")
        .join(met, "row_id", "left")
        .join(seldom_coded, "row_id", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (
                F.col("part") + F.coalesce("more_part", F.lit(0.0)) - F.col("n_tokens") * math.log10(total + distinct + 1)
            ).alias("base_score"),
            ((F.col("bits") + F.coalesce("more_bits", F.lit(0.0))) * -math.log10(2)).alias("score"),
        )
    )
