"""Quality rules on cross-document line frequency.

Lines are normalised (A-Z lower-cased, blanks squeezed) and hashed; per host the number of distinct
documents (by content) that hold a line is counted. Lines above the limit are taken out of the text
and a document that this depletes is rejected.
"""

from __future__ import annotations

from itertools import compress

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.llm._common import columns_of, map_bytes, quoted, staged, unused

BLANKS = b" \t\n\x0b\x0c\r"
#: Deleting these from UTF-8 leaves one byte for each code point that stands in a word.
NOT_COUNTED = BLANKS + bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"


def text_stats(raw: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not raw:
        return 0, 0, 0, 0, 0
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(BLANKS)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen: set = set()
        again = {x for x in windows if x in seen or seen.add(x)}
        end = 0
        for at in compress(range(len(windows)), map(again.__contains__, windows)):
            repeated += at + 3 - max(at, end)
            end = at + 3
    return (
        len(words),
        len(raw.translate(None, NOT_COUNTED)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
    )


def line_hash(line: bytes) -> int | None:
    """Of the normalised line, as a signed long; None for a line without a word."""
    squeezed = b" ".join(line.lower().split())
    return xxhash.xxh3_64_intdigest(squeezed) - (1 << 63) if squeezed else None


def line_words(raw: bytes | None) -> dict[int, int]:
    """Words on each distinct line, by its hash."""
    found: dict[int, int] = {}
    for line in (raw or b"").split(b"\n"):
        if (key := line_hash(line)) is not None:
            found[key] = found.get(key, 0) + len(line.split())
    return found


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def line_table(docs: DataFrame, host: str) -> DataFrame:
    """Staged: a row for each row of docs, with its statistics and its lines. row_id is unique in
    the written table, whatever the ids of docs."""
    rows = docs.select(
        F.col("doc_id"),
        F.col(host).cast("string").alias("host"),
        F.xxhash64("text").alias("content"),
        F.monotonically_increasing_id().alias("row_id"),
        F.col("text"),
    )
    line = T.StructType([T.StructField("line", T.LongType()), T.StructField("words", T.IntegerType())])
    schema = T.StructType(
        [*rows.drop("text").schema.fields, *[T.StructField(n, T.LongType()) for n in STATS], T.StructField("lines", T.ArrayType(line))]
    )

    def run(others: dict, texts: list[bytes | None]) -> dict:
        stats = list(zip(*map(text_stats, texts), strict=True)) or [()] * len(STATS)
        lines = [[{"line": k, "words": n} for k, n in line_words(t).items()] for t in texts]
        return others | dict(zip(STATS, stats, strict=True)) | {"lines": lines}

    return staged(map_bytes(rows, run, schema), "lines")


def frequent_lines(lines: DataFrame, least_documents: int, share: float) -> DataFrame:
    """host, line: those in more than max(least_documents, share of the host's) distinct documents.
    Copies fold into one document before lines are counted; all counts have map-side partial sums."""
    contents = lines.select("host", "content").distinct()
    limits = contents.groupBy("host").agg(F.greatest(F.lit(float(least_documents)), F.count("*") * F.lit(share)).alias("most"))
    held = (
        lines.select("host", "content", F.explode("lines.line").alias("line"))
        .distinct()
        .groupBy("host", "line")
        .agg(F.count("*").alias("documents"))
        .where(F.col("documents") > least_documents)
    )
    return (
        held.alias("h")
        .join(limits.alias("m"), F.col("h.host").eqNullSafe(F.col("m.host")))
        .where(F.col("documents") > F.col("most"))
        .select(F.col("h.host").alias("host"), "line")
    )


def judge(
    docs: DataFrame,
    host: str = "source",
    least_documents: int = 30,
    share: float = 0.02,
    least_left: float = 0.5,
) -> DataFrame:
    """doc_id, the statistics, base_failed, removed_words, kept and frequent (hashes of the lines
    to take out) of every row.

    A line is too frequent on a host when more than least_documents and more than share of the
    host's distinct documents hold it; a document is depleted when less than least_left of its
    words remain. Both limits hold at every size. Null hosts are one host; a null text is an empty
    one, and fails the base rule. Repeated rows are judged alike; copies count as one document.
    """
    lines = line_table(columns_of(docs, "doc_id", host, "text") if host != "text" else docs, host)
    frequent = frequent_lines(lines, least_documents, share)
    # A row for each row and line; a common line is a hot key of a plain equi-join, which AQE splits.
    each = lines.select("row_id", "host", F.explode("lines").alias("of")).select("row_id", "host", "of.line", "of.words")
    removed = (
        each.alias("e")
        .join(frequent.alias("f"), (F.col("e.line") == F.col("f.line")) & F.col("e.host").eqNullSafe(F.col("f.host")))
        .groupBy(F.col("e.row_id").alias("row_id"))
        .agg(F.sum("words").alias("removed_words"), F.collect_set(F.col("e.line")).alias("frequent"))
    )
    gone = F.coalesce(F.col("removed_words"), F.lit(0))
    depleted = (F.col("n_words") - gone) < F.lit(least_left) * F.col("n_words")
    return (
        lines.drop("lines")
        .join(removed, "row_id", "left")
        .select(
            "doc_id", "content", *STATS, base_failed().alias("base_failed"), gone.alias("removed_words"),
            (~base_failed() & ~depleted).alias("kept"), "frequent",
        )
    )


def without_lines(raw: bytes, hashes: set[int]) -> bytes:
    return b"\n".join(x for x in raw.split(b"\n") if line_hash(x) not in hashes)


def apply_rules(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """docs without the rejected rows, and without the frequent lines in the kept ones' texts; all
    columns stay. A kept row that loses no line is unchanged. Empty input gives empty output."""
    names = docs.columns
    content, hashes, same = (unused(names, n) for n in ("content", "frequent", "same_id"))
    verdict = (
        judge(docs, host, **limits)
        .where("kept")
        .groupBy(F.col("doc_id").alias(same), F.col("content").alias(content))
        .agg(F.first("frequent").alias(hashes))
    )
    marked = docs.withColumn(content + "_", F.xxhash64("text"))
    kept = marked.join(
        verdict, marked["doc_id"].eqNullSafe(verdict[same]) & (marked[content + "_"] == verdict[content])
    ).select(*quoted(names), hashes)
    clean = kept.where(F.col(hashes).isNull()).drop(hashes)
    dirty = kept.where(F.col(hashes).isNotNull())

    def run(others: dict, texts: list[bytes | None]) -> dict:
        gone = others[hashes].to_pylist()
        return others | {"text": [without_lines(t, set(h)) for t, h in zip(texts, gone, strict=True)]}

    cut = map_bytes(dirty, run, dirty.schema).drop(hashes)
    return clean.unionByName(cut)
