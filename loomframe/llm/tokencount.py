"""Token counts of a SentencePiece BPE model by a map-side two-tier lookup.

A pre-token is a maximal run of blanks with the run of other characters after it. No piece of the
model holds a blank after another character (checked when the model is loaded), so no merge crosses
a pre-token's start, and a text's tokens are the sum over its pre-tokens.

Tier one is a broadcast hash table of the lengths of pre-tokens that are frequent in a bounded
sample; tier two encodes misses and keeps their lengths in a cache of the Python worker. Either
tier gives the library's own lengths, so the sample decides speed only. There is no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.llm._common import columns_of, map_bytes

BLANK = "▁"
#: Worker caches, by model path; they outlive a task as Python workers are reused.
_models: dict[str, object] = {}
_caches: dict[str, dict[str, int]] = {}
_PRE = re.compile(" *[^ ]+| +")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str):
    """The processor of this worker. Raises if lengths would not add up over pre-tokens."""
    if path not in _models:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if not model.is_control(i) and not model.is_unknown(i) and BLANK in piece.lstrip(BLANK):
                raise ValueError(f"piece {piece!r} crosses a pre-token's start")
        _models[path] = model
    return _models[path]


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens whose own encodings, each without the library's leading blank, join to the text's."""
    if not text:
        return []
    text = " " + text.replace(BLANK, " ")
    if "  " not in text and text[-1] != " ":
        return text[1:].split(" ")
    return [p[1:] for p in _PRE.findall(text)]


def lengths(model, tokens: list[str]) -> list[int]:
    """The library adds one leading blank, which stands for the blank that pre_tokens() took off.
    An empty token is that blank alone."""
    alone = len(model.encode(" ")) and 1
    return [len(ids) if t else alone for t, ids in zip(tokens, model.encode(tokens, num_threads=1), strict=True)]


def frequent_lengths(docs: DataFrame, path: str, sample_rows: int, entries: int, text_bytes: int = 1 << 16) -> dict[str, int]:
    """The table to broadcast: at most entries pre-tokens, from at most sample_rows rows of at most
    text_bytes each, so that the driver holds a bounded number of bytes."""
    seen: Counter[str] = Counter()
    short = docs.select("text").where(F.octet_length("text") <= text_bytes)
    for row in short.limit(sample_rows).toLocalIterator():
        seen.update(pre_tokens(row[0]))
    tokens = [t for t, _ in seen.most_common(entries) if len(t) <= 64]
    return dict(zip(tokens, lengths(load(path), tokens), strict=True)) if tokens else {}


def count_tokens(
    docs: DataFrame,
    model_path: str | None = None,
    token_limit: int = 4096,
    sample_rows: int = 1000,
    table_entries: int = 50_000,
    cache_entries: int = 300_000,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows and null ids are counted row by
    row. Columns other than doc_id and text are ignored. An empty table gives an empty result.
    """
    path = model_path or default_model()
    rows = columns_of(docs, "doc_id", "text")
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(rows, path, sample_rows, table_entries))
    schema = T.StructType(
        [
            T.StructField("doc_id", rows.schema["doc_id"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )

    def run(others: dict, texts: list[bytes | None]) -> dict:
        model, frequent = load(path), table.value
        cache = _caches.setdefault(path, {})
        counts = []
        for raw in texts:
            tokens = pre_tokens(raw.decode("utf-8", "replace")) if raw else []
            found = list(map(frequent.get, tokens))
            total = sum(n for n in found if n is not None)
            missed = [t for t, n in zip(tokens, found, strict=True) if n is None]
            if missed:
                new = [t for t in set(missed) if t not in cache]
                sized = dict(zip(new, lengths(model, new), strict=True)) if new else {}
                total += sum(sized[t] if t in sized else cache[t] for t in missed)
                if len(cache) + len(sized) > cache_entries:
                    cache.clear()
                cache.update((t, n) for t, n in sized.items() if len(t) <= 64)
            counts.append(total)
        return {
            "doc_id": others["doc_id"],
            "n_bytes": [len(t) if t else 0 for t in texts],
            "n_tokens": counts,
            "over_limit": [n > token_limit for n in counts],
        }

    return map_bytes(rows, run, schema)
