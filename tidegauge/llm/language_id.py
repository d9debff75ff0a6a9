"""Language identification by prediction by partial matching.

For each language a context tree over bytes holds how often each byte followed each context of 0 to `ORDER` bytes. The
code length of a byte starts in the longest context: a byte seen n times there, among T bytes of D kinds, costs
-log2(n / (T + D)); otherwise the escape costs -log2(D / (T + D)) and the next shorter context is asked, down to 8 bits. A context that the
language never had escapes for free. Statistics are frozen before scoring. A text goes to the language with the shortest code.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import SLICE_BYTES, col, map_slices, release, slices, texts
from tidegauge.llm.hashing import IntTable

ORDER = 3
UNKNOWN = "und"
#: Bits of evidence per byte count for as many bytes at most, so that a score below 1 keeps its meaning on long texts.
EVIDENCE_BYTES = 64
#: Different grams that a task counts together before they leave it.
TOGETHER = 1 << 20
_letter = regex.compile(r"\p{L}")


def grams(batch: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order k the codes of all (k+1)-grams that end at each byte, and each text's number of bytes.

    Texts are in lower case; zero bytes stand before the first one.
    """
    return byte_grams([t.lower().encode() for t in batch])


def byte_grams(raw: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """grams() of bytes."""
    size = np.array([len(r) for r in raw], np.int64)
    line = np.frombuffer(b"".join(bytes(ORDER) + r for r in raw), np.uint8).astype(np.int64)
    starts = np.cumsum(size + ORDER) - size
    at = np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)
    code, out = np.zeros(len(at), np.int64), []
    for k in range(ORDER + 1):
        code = code | line[at - k] << 8 * k
        out.append(code)
    return out, size


@dataclass
class ContextTrees:
    """By order k: the (k+1)-grams of any language with their full costs in each language, and the contexts with their escapes."""

    languages: list[str]
    keys: list[np.ndarray]
    costs: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def __post_init__(self):
        self.tables = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "tables"} | {"tables": None}

    def bits(self, codes: list[np.ndarray]) -> np.ndarray:
        """Cost of every byte in every language."""
        if self.tables is None:
            self.tables = [(IntTable.of(k), IntTable.of(c)) for k, c in zip(self.keys, self.contexts)]
        n = len(codes[0])
        total = np.zeros((n, len(self.languages)), np.float32)
        open_ = np.arange(n)
        for k in range(ORDER, -1, -1):
            by_gram, by_context = self.tables[k]
            code = codes[k][open_]
            at = by_gram.find(code)
            hit = at >= 0
            total[open_[hit]] += self.costs[k][at[hit]]
            open_ = open_[~hit]
            at = by_context.find(code[~hit] >> 8)
            total[open_[at >= 0]] += self.escapes[k][at[at >= 0]]
        total[open_] += 8
        return total


def context_trees(languages: list[str], rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> ContextTrees:
    """From (gram code, language number, count) of every order."""
    trees = ContextTrees(languages, [], [], [], [])
    for k, (code, language, count) in enumerate(rows):
        keys, at = np.unique(code, return_inverse=True)
        n = np.zeros((len(keys), len(languages)))
        np.add.at(n, (at, language), count)
        contexts, of = np.unique(keys >> 8, return_inverse=True)
        total, kinds = (np.zeros((len(contexts), len(languages))) for _ in range(2))
        np.add.at(total, of, n)
        np.add.at(kinds, of, n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
            here = -np.log2(n / (total + kinds)[of])
        if k:
            shorter = trees.costs[-1][np.searchsorted(trees.keys[-1], keys & ((1 << 8 * k) - 1))]
        else:
            shorter = np.full(n.shape, 8.0)
        cost = np.where(n > 0, here, escape[of] + shorter)
        for line, value in ((trees.keys, keys), (trees.costs, cost.astype(np.float32)), (trees.contexts, contexts), (trees.escapes, escape.astype(np.float32))):
            line.append(value)
    return trees


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    key, at = np.unique(key, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, at, n)
    return key, total


def gram_counts(batches):
    """Counts of the (ORDER+1)-grams of whole texts by language. A task sums up what it meets; long texts go piece by piece."""
    keys, counts, held = [], [], 0
    for batch in batches:
        for part in slices(batch):
            raw = [t.lower().encode() for t in part.column("text").to_pylist()]
            language = part.column("language").to_numpy(zero_copy_only=False).astype(np.int64)
            step = SLICE_BYTES if len(raw) == 1 else max(map(len, raw)) + 1  # a slice of several texts is short
            for offset in range(0, max(map(len, raw)), step):
                before = min(offset, ORDER)  # bytes that are only context here
                codes, size = byte_grams([r[offset - before : offset + step] for r in raw])
                key, n = np.unique((codes[ORDER] | np.repeat(language, size) << 32)[before:], return_counts=True)
                keys.append(key)
                counts.append(n)
                held += len(key)
                if held > TOGETHER:
                    key, n = summed(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, held = [key], [n], len(key)
                    if held > TOGETHER // 2:
                        yield pa.RecordBatch.from_pydict({"code": key & 0xFFFFFFFF, "language": pa.array(key >> 32, pa.int32()), "n": n})
                        keys, counts, held = [], [], 0
        release()
    if held:
        key, n = summed(np.concatenate(keys), np.concatenate(counts))
        yield pa.RecordBatch.from_pydict({"code": key & 0xFFFFFFFF, "language": pa.array(key >> 32, pa.int32()), "n": n})


def learn(df: DataFrame, lang_col: str, condition: Column, sample_rows: int, id_col: str, text_col: str) -> ContextTrees | None:
    """Context trees from about `sample_rows` whole texts per language, whatever their length.

    The sample is chosen by a hash of text and id, so every run and every retry takes the same rows.
    """
    known = df.filter(condition & col(lang_col).isNotNull() & col(text_col).isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy(col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return None
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, sample_rows / counts[name]))])
    number = F.create_map(*[F.lit(x) for i, name in enumerate(languages) for x in (name, i)])
    lang = col(lang_col).cast("string")
    place = F.pmod(F.xxhash64(col(id_col).cast("string"), col(text_col)), F.lit(1 << 30)) / (1 << 30)
    sample = texts(known.filter(place < share[lang]), id_col, text_col, number[lang].alias("language"))
    counted = sample.mapInArrow(gram_counts, "code bigint, language int, n bigint").groupBy("code", "language").agg(F.sum("n").alias("n"))
    got = counted.toPandas()
    code, language, n = (got[c].to_numpy() for c in ("code", "language", "n"))
    # The last bytes of the longest grams are the shorter ones.
    return context_trees(languages, [(code & ((1 << 8 * (k + 1)) - 1), language, n) for k in range(ORDER + 1)])


def identify(df: DataFrame, learn_on: Column | None = None, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
             sample_rows: int = 2000, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score for every whole text, and the columns `keep` of the frame.

    Languages are learned from whole texts of the rows where `learn_on` holds (all, if None) and text and language are not null. Null texts and texts
    without a letter are `und` with score 0, as is every text when nothing was learned. Equal code lengths go to the first language
    in alphabetical order. The score is the share of the best language when each code counts for at most 64 bytes. Repeated rows are
    judged each on its own.
    """
    trees = learn(df, lang_col, F.lit(True) if learn_on is None else learn_on, sample_rows, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()
    types = {f"_k{i}": df.schema[n].dataType.simpleString() for i, n in enumerate(keep)}
    rows = texts(df, id_col, text_col, *[col(n).alias(f"_k{i}") for i, n in enumerate(keep)])
    # Bounded by the sample, see learn().
    held = df.sparkSession.sparkContext.broadcast(trees)

    def step(batch: pa.RecordBatch) -> dict:
        trees, every = held.value, batch.column("text").to_pylist()
        names, scores = np.full(len(every), UNKNOWN, object), np.zeros(len(every))
        judged = np.flatnonzero([trees is not None and _letter.search(t) is not None for t in every])
        if len(judged):
            codes, size = grams([every[i] for i in judged])
            ends = np.cumsum(size)
            bits = np.add.reduceat(trees.bits(codes), ends - size, axis=0, dtype=float)
            best = bits.argmin(1)
            behind = (bits - bits.min(1, keepdims=True)) * np.minimum(1, EVIDENCE_BYTES / size)[:, None]
            names[judged] = np.array(trees.languages, object)[best]
            scores[judged] = 1 / np.exp2(-behind).sum(1)
        return {"doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": scores, **{n: batch.column(n) for n in types}}

    schema = f"doc_id {kind}, lang_pred string, score double" + "".join(f", {n} {t}" for n, t in types.items())
    found = map_slices(rows, step, schema)
    return found.select("doc_id", "lang_pred", "score", *[F.col(f"_k{i}").alias(n) for i, n in enumerate(keep)])
