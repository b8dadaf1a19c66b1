"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by
stochastic gradient descent in numpy, with calibrated rejection.

A subword is a run of 2 to 4 UTF-8 bytes (ASCII letters lower-cased, other ASCII folded to one
separator) with separators at its ends only. A text's vector is the mean embedding of its subwords.
"""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomframe.llm._common import columns_of, id_remainder, map_bytes

UNKNOWN = "und"
#: Bytes to lower-case letters and bytes beyond ASCII; all else to 32.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)
_SIZES = (2, 3, 4)
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(raw: bytes | None) -> bool:
    return bool(raw) and bool(_ASCII_LETTER.search(raw) or any(map(str.isalpha, raw.decode("utf-8", "replace"))))


def subwords(buffer: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size, the bucket of the subword that starts at each byte, and whether it is one."""
    b = _FOLD[buffer]
    gap = b == 32
    wide = b.astype(np.uint32)
    out = []
    for n in _SIZES:
        m = len(b) - n + 1
        if m <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(0, bool)))
            continue
        packed = np.zeros(m, np.uint32)
        for k in range(n):
            packed = (packed << np.uint32(8)) | wide[k : k + m]
        hashed = (packed ^ np.uint32(n * 0x01000193)) * np.uint32(0x9E3779B1)
        hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        ok = ~(gap[:m] & gap[n - 1 : n - 1 + m]) if n == 2 else np.ones(m, bool)
        for k in range(1, n - 1):
            ok &= ~gap[k : k + m]
        out.append(((hashed >> np.uint32(32 - bits)).astype(np.int64), ok))
    return out


def bag(raw: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their shares of a text's subwords."""
    buffer = np.frombuffer(b" " + raw + b" ", np.uint8)
    found = np.concatenate([ids[ok] for ids, ok in subwords(buffer, bits)])
    ids, n = np.unique(found, return_counts=True)
    return ids, (n / max(1, n.sum())).astype(np.float32)


@dataclass
class Model:
    """table: bucket -> scores of the labels (embedding times output weights, over the temperature);
    below threshold a prediction is rejected."""

    labels: list[str]
    bits: int
    table: np.ndarray
    bias: np.ndarray
    threshold: float
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def scores(self, texts: list[bytes], most: int = 1 << 19) -> np.ndarray:
        """Probabilities, a row for each text."""
        found, held, at = [np.zeros((0, len(self.labels)))], 0, 0
        for i, t in enumerate(texts):  # about half a megabyte at a time, so that arrays stay in caches
            held += len(t)
            if held > most or i + 1 == len(texts):
                found.append(self._scores(texts[at : i + 1]))
                held, at = 0, i + 1
        return np.concatenate(found)

    def _scores(self, texts: list[bytes]) -> np.ndarray:
        """Texts in one buffer, a separator between them. No subword holds one inside, so each
        belongs to the text, with the separator before it, in which it starts."""
        buffer = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
        none = len(self.table)
        columns = [np.append(self.table[:, c], np.float32(0)) for c in range(len(self.labels))]
        total = np.zeros((len(self.labels), len(buffer)), np.float32)
        count = np.zeros(len(buffer), np.int64)
        for ids, ok in subwords(buffer, self.bits):
            ids = np.where(ok, ids, none)
            count[: len(ids)] += ok
            for c, column in enumerate(columns):
                total[c, : len(ids)] += column.take(ids)
        sums = np.add.reduceat(total, starts, axis=1, dtype=np.float64).T
        z = sums / np.maximum(np.add.reduceat(count, starts), 1)[:, None] + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(
    rows: list[tuple[int, bytes, str]], bits: int = 16, width: int = 16, epochs: int = 2, rate: float = 0.5,
    accuracy: float = 0.99, seed: int = 7,
) -> Model:
    """SGD over whole texts and their lines. A fifth of the texts sets the softmax's temperature
    and the threshold above which accuracy is reached. Same rows, same model."""
    labels = sorted({x for _, _, x in rows})
    rng = np.random.default_rng(seed)
    if not labels:
        return Model([], bits, np.zeros((1 << bits, 0), np.float32), np.zeros(0), 0.0)
    order = rng.permutation(len(rows))
    checked = [rows[i] for i in order[: len(rows) // 5]]
    fitted = [rows[i] for i in order[len(rows) // 5 :]] or rows
    examples = []
    for _, raw, label in fitted:
        y = labels.index(label)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        examples += [(*bag(x, bits), y) for x in [raw, *(lines if len(lines) > 1 else [])]]
    examples = [x for x in examples if len(x[0])]
    emb = rng.uniform(-1 / width, 1 / width, (1 << bits, width)).astype(np.float32)
    out = np.zeros((width, len(labels)), np.float32)
    bias = np.zeros(len(labels), np.float32)
    steps, done = max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            ids, share, y = examples[i]
            lr = np.float32(rate * (1 - done / steps))
            done += 1
            hidden = share @ emb[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= lr * np.outer(hidden, p)
            bias -= lr * p * np.float32(0.1)
            # A bucket's share is small, so embeddings take the step by share times its inverse mean.
            emb[ids] -= lr * np.outer(share * min(len(ids), 50), back)
    plain = Model(labels, bits, emb @ out, bias.astype(np.float64), 0.0)
    return calibrate(plain, checked, accuracy)


def calibrate(model: Model, rows: list[tuple[int, bytes, str]], accuracy: float) -> Model:
    """Temperature of least log loss on rows; the least score from which on rows reach accuracy."""
    rows = [r for r in rows if has_letter(r[1])]
    if not rows:
        return model
    y = np.array([model.labels.index(x) for _, _, x in rows])
    texts = [t for _, t, _ in rows]
    best = (math.inf, 1.0)
    for heat in np.geomspace(0.05, 20, 41):
        p = Model(model.labels, model.bits, model.table / np.float32(heat), model.bias / heat, 0.0).scores(texts)
        best = min(best, (float(-np.log(p[np.arange(len(y)), y] + 1e-12).mean()), float(heat)))
    heat = best[1]
    model = Model(model.labels, model.bits, (model.table / np.float32(heat)).astype(np.float32), model.bias / heat, 0.0)
    p = model.scores(texts)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    threshold = 0.0
    for t in np.sort(top):
        threshold = float(t)
        if right[top >= t].mean() >= accuracy:
            break
    model.threshold = threshold
    return model


def labelled_sample(
    docs: DataFrame, per_label: int, held_out: int, folds: int, text_bytes: int = 1 << 16
) -> list[tuple[int, bytes, str]]:
    """At most per_label distinct texts of each label, from the rows whose crc32(doc_id) mod folds is
    not held_out: those with the least hash, of the texts of at most text_bytes. A text that is
    repeated counts once, so the driver gets at most per_label * text_bytes a label. Ordered, so that
    a rerun trains the same model."""
    fold = F.coalesce(id_remainder(F.col("doc_id"), folds) == held_out, F.lit(False))
    known = docs.where(~fold & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= text_bytes))
    draws = known.select("lang", "doc_id", F.xxhash64(F.lit("langid"), "text").alias("draw"))
    # About twice as many as are wanted, by a limit on the hash; then exactly the least of them.
    share = draws.groupBy(F.col("lang").alias("of")).agg((2.0 * per_label / F.approx_count_distinct("draw")).alias("share"))
    low = F.shiftrightunsigned("draw", 11) < F.col("share") * float(1 << 53)
    near = draws.join(share, F.col("lang") == F.col("of")).where(low).groupBy("lang", "draw").agg(F.min("doc_id").alias("doc_id"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("draw", 11), "draw"))
    chosen = near.withColumn("place", place).where(F.col("place") <= per_label)
    chosen = chosen.select(F.col("lang").alias("of"), F.col("draw").alias("same"), F.col("doc_id").alias("least_id"))
    texts = known.withColumn("draw", F.xxhash64(F.lit("langid"), "text"))
    same = (texts["lang"] == chosen["of"]) & (texts["draw"] == chosen["same"]) & texts["doc_id"].eqNullSafe(chosen["least_id"])
    # At most per_label rows a label, of ids and hashes.
    found = texts.join(F.broadcast(chosen), same, "left_semi").dropDuplicates(["lang", "draw"])
    rows = found.select("lang", "draw", "doc_id", F.col("text").cast("binary").alias("text")).collect()
    return [(r["doc_id"], bytes(r["text"]), r["lang"]) for r in sorted(rows, key=lambda r: (r["lang"], r["draw"]))]


def identify(docs: DataFrame, per_label: int = 300, held_out: int = 2, folds: int = 4, **training) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the label's calibrated probability) and accepted (it
    reaches the threshold) of every row.

    The model learns from at most per_label distinct labelled texts of each language, of at most 64 KB
    each, outside the held out fold; it needs a number of languages that suits a driver. A text that is null or has no
    letter gives und, score 0 and not accepted, as does every text if there is nothing to learn
    from. A null id counts as not held out. Repeated rows and extra columns do not matter.
    """
    rows = columns_of(docs, "doc_id", "text", "lang")
    model = train(labelled_sample(rows, per_label, held_out, folds), **training)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = rows.select(
        "doc_id", F.coalesce(id_remainder(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "text"
    )
    schema = T.StructType(
        [
            *texts.drop("text").schema.fields,
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("accepted", T.BooleanType()),
        ]
    )

    def run(others: dict, raw: list[bytes | None]) -> dict:
        model = shared.value
        told = [bool(model.labels) and has_letter(t) for t in raw]
        p = model.scores([t for t, ok in zip(raw, told, strict=True) if ok])
        pred, score, accepted = [UNKNOWN] * len(raw), [0.0] * len(raw), [False] * len(raw)
        for row, i in zip(p, [i for i, ok in enumerate(told) if ok], strict=True):
            k = int(row.argmax())
            pred[i], score[i], accepted[i] = model.labels[k], float(row[k]), bool(row[k] >= model.threshold)
        return others | {"lang_pred": pred, "score": score, "accepted": accepted}

    return map_bytes(texts, run, schema)
