"""Toxicity by class-conditional Kneser-Ney models.

Two models of letters, of toxic and of ordinary texts, predict each letter from the three before it. A class discounts its own
four-letter counts and gives the rest to one backoff distribution that both share: continuation counts of the pooled
classes, interpolated down to single letters. So an expression that a class has hardly seen is judged by its
parts. Letters are folded to 32 symbols, which bounds the models at 2**20 numbers for any corpus; their counts
cover every labelled training text.

A text is compared by its length-normalised log-likelihoods under both models: over all its letters, and over the words
that lean most to the toxic model, as a few expressions do not show in the average of a long text. A small logistic
calibration on training texts that the counts left out turns the comparison into a score.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import col, map_slices, slices, texts
from tidegauge.session import cut_lineage

ORDER, SYMBOLS, DISCOUNT = 4, 32, 0.75
GAP, DIGIT = 0, 27
TOP_WORDS = 3
FEATURES = ["mean", "peak", "log_words"]


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """Symbol of every code point: 1-26 for letters by their base letter (others by code point), 27 for digits, 0 for the rest."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            base = unicodedata.normalize("NFKD", c)[0].lower() if point > 127 else c.lower()
            table[point] = ord(base) - 96 if "a" <= base <= "z" else 1 + point % 26
        elif c.isdigit():
            table[point] = DIGIT
    return table


def codes(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Four-symbol codes of all texts in one line, whether each ends at a gap, and each text's number of codes.

    Between words there is one gap; a text begins and ends with one.
    """
    line = symbols()[np.frombuffer("".join(f" {t} " for t in batch).encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int64)
    size = np.array([len(t) + 2 for t in batch], np.int64)
    kept = np.ones(len(line), bool)
    kept[1:] = (line[1:] != GAP) | (line[:-1] != GAP)
    first = np.cumsum(size) - size
    kept[first] = True
    text = np.repeat(np.arange(len(batch)), size)[kept]
    line = line[kept]
    size = np.bincount(text, minlength=len(batch))
    code, begin = line.copy(), np.repeat(np.cumsum(size) - size, size)
    for k in range(1, ORDER):
        # What comes before a text counts as gaps.
        code[k:] += np.where(np.arange(k, len(line)) - k >= begin[k:], line[:-k], GAP) << 5 * k
    return code, line == GAP, size


def interpolated(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Discounted relative counts plus the held-back share of the lower order; contexts without counts take the lower order."""
    counts = counts.reshape(-1, SYMBOLS)
    lower = np.resize(lower.reshape(-1, SYMBOLS), counts.shape)
    total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    return np.where(total > 0, (np.maximum(counts - DISCOUNT, 0) + DISCOUNT * kinds * lower) / np.maximum(total, 1), lower)


def log_ratio(toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """log P(symbol | context, toxic) - log P(symbol | context, ordinary) for every code."""
    shared = np.full(SYMBOLS, 1 / SYMBOLS)
    grams = [toxic + ordinary]
    for _ in range(ORDER - 1):
        grams.append((grams[-1].reshape(SYMBOLS, -1) > 0).sum(0).astype(float))  # in how many contexts more to the left
    for counts in reversed(grams[1:]):
        shared = interpolated(counts, shared)
    return (np.log(interpolated(toxic, shared)) - np.log(interpolated(ordinary, shared))).reshape(-1).astype(np.float32)


def class_counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Four-symbol counts of toxic and of ordinary texts; each task sends one row per code it met, 2**20 at most."""

    def run(batches):
        counts = np.zeros((2, SYMBOLS**ORDER), np.int64)
        for batch in batches:
            for part in slices(batch):
                code, _, size = codes(part.column("text").to_pylist())
                label = np.repeat(part.column("label").to_numpy(zero_copy_only=False), size)
                for y in (0, 1):
                    counts[y] += np.bincount(code[label == y], minlength=counts.shape[1])
        met = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_pydict({"code": pa.array(met, pa.int32()), "n0": counts[0, met], "n1": counts[1, met]})

    found = labelled.mapInArrow(run, "code int, n0 bigint, n1 bigint").groupBy("code").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    out = np.zeros((2, SYMBOLS**ORDER))
    out[0, found.code], out[1, found.code] = found.n0, found.n1
    return out[1], out[0]


def compared(df: DataFrame, ratio: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """doc_id and the length-normalised comparison of each whole text: mean, peak, log_words."""
    held = df.sparkSession.sparkContext.broadcast(ratio)  # 4 MB, fixed

    def step(batch: pa.RecordBatch) -> dict:
        code, gap, size = codes(batch.column("text").to_pylist())
        value, n = held.value[code].astype(float), len(size)
        text = np.repeat(np.arange(n), size)
        mean = np.bincount(text, value, n) / np.maximum(size, 1)
        # A word runs up to and with the gap that ends it.
        word = np.cumsum(gap) - gap
        sums = np.bincount(word, value)
        owner = np.zeros(len(sums), np.int64)
        owner[word] = text
        order = np.lexsort((-sums, owner))
        count = np.bincount(owner, minlength=n)
        rank = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)
        top = order[rank < TOP_WORDS]
        peak = np.bincount(owner[top], sums[top], n) / TOP_WORDS
        return {"doc_id": batch.column("doc_id"), "mean": mean, "peak": peak, "log_words": np.log1p(count)}

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(texts(df, id_col, text_col), step, f"doc_id {kind}, mean double, peak double, log_words double")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 100) -> np.ndarray:
    """Weights (bias last) of a ridge logistic fit by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step * min(1, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(df: DataFrame, labels: DataFrame, label_col: str = "toxic", learn_on: Column | None = None, id_col: str = "doc_id",
                   text_col: str = "text", calibration_rows: int = 20000) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text.

    Labels (id and 0/1 in `label_col`; null ones are left out, of repeated ones the highest holds) count where `learn_on`, a condition on the
    id, holds. Nine tenths of the labelled texts, by a hash of the id, give the counts, however many there are; of the rest about `calibration_rows`
    calibrate. Null and empty texts are scored as texts without a letter. Without labels of both classes every score is the share
    of toxic labels, 0 without any. Repeated rows are scored each on its own.
    """
    known = labels.select(col(id_col).alias("doc_id"), col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & (F.lit(True) if learn_on is None else learn_on))
    # One plan at every size: a label table that is small today must not change how texts move.
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).hint("merge")
    counting = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(10)) > 0
    toxic, ordinary = class_counts(texts(df, id_col, text_col).join(known.filter(counting), "doc_id").select("text", "label"))
    if not toxic.any() or not ordinary.any():
        share = known.agg(F.avg("label")).first()[0] or 0.0
        return df.select(col(id_col).alias("doc_id"), F.lit(float(share)).alias("score"))
    rows = cut_lineage(compared(df, log_ratio(toxic, ordinary), id_col, text_col))
    rest = rows.join(known.filter(~counting), "doc_id")
    share = min(1.0, calibration_rows / max(1, rest.count()))
    place = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(1 << 30)) / (1 << 30)
    sample = rest.filter(place < share).select(*FEATURES, "label").toPandas()
    if sample.label.nunique() < 2:  # too few to calibrate: the peak of a word against even odds
        weights = np.array([0.0, 0.5, 0.0, -2.5])
    else:
        weights = logistic(sample[FEATURES].to_numpy(), sample.label.to_numpy())
    total = sum((F.col(n) * float(w) for n, w in zip(FEATURES, weights)), F.lit(float(weights[-1])))
    return rows.select("doc_id", (1 / (1 + F.exp(-total))).alias("score"))
