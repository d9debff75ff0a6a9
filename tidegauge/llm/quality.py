"""Quality by a sparse rule ensemble.

Statistics of a text (shape, repetition, symbols) feed a small random forest; the path to each of its nodes is a conjunctive rule.
A lasso logistic fit over all rules keeps a few of them with a weight, and these are compiled into one Spark column
expression, so scoring is plain column arithmetic.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import col, map_slices, texts
from tidegauge.session import cut_lineage

STATISTICS = ["log_chars", "log_words", "word_length", "upper", "digits", "symbols", "marks", "white", "letters", "distinct_words", "most_frequent_word",
              "same_as_previous", "distinct_lines", "longest_word", "symbol_words", "upper_words"]
_SYMBOLS = frozenset("#$%&*@^~|<>{}[]\\/=+_")


def character_groups() -> np.ndarray:
    """Group of every code point: 1 upper case, 2 other letters, 3 digits, 4 symbols, 5 punctuation, 6 white space."""
    groups = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            groups[point] = 1 if c.isupper() else 2
        elif c.isdigit():
            groups[point] = 3
        elif c in _SYMBOLS:
            groups[point] = 4
        elif c.isspace():
            groups[point] = 6
        elif c.isprintable():
            groups[point] = 5
    return groups


_groups: list[np.ndarray] = []


def statistics_of(batch: list[str]) -> dict[str, np.ndarray]:
    if not _groups:
        _groups.append(character_groups())
    size = np.array([len(t) for t in batch], np.int64)
    # One blank after each text gives every text a span that is not empty.
    kinds = _groups[0][np.frombuffer("".join(t + " " for t in batch).encode("utf-32-le", "surrogatepass"), "<u4")]
    starts = np.cumsum(size + 1) - size - 1
    share = {g: np.add.reduceat((kinds == g).astype(np.int64), starts) for g in range(1, 7)}
    share[6] = share[6] - 1
    n = np.maximum(size, 1)
    rows = []
    for text in batch:
        words, lines = text.split(), [x for x in text.split("\n") if x]
        if not words:
            rows.append((0, 0, 1, 0, 0, 1, 0, 0, 0))
            continue
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        w = len(words)
        rows.append((w, sum(map(len, words)) / w, len(counts) / w, max(counts.values()) / w, sum(map(str.__eq__, words[1:], words)) / w,
                     len(set(lines)) / max(1, len(lines)), max(map(len, counts)), sum(n for x, n in counts.items() if not x[-1].isalnum() and x[-1] not in ".,;:?!") / w,
                     sum(n for x, n in counts.items() if x.isupper() and len(x) > 1) / w))
    words, length, distinct, frequent, same, lines, longest, marked, shouted = np.array(rows, float).reshape(-1, 9).T
    return {"log_chars": np.log1p(size), "log_words": np.log1p(words), "word_length": length, "upper": share[1] / n, "digits": share[3] / n, "symbols": share[4] / n,
            "marks": share[5] / n, "white": share[6] / n, "letters": (share[1] + share[2]) / n, "distinct_words": distinct, "most_frequent_word": frequent,
            "same_as_previous": same, "distinct_lines": lines, "longest_word": longest, "symbol_words": marked, "upper_words": shouted}


def text_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and STATISTICS of each whole text; null and empty texts give zeros, and 1 for the share of distinct words and lines as far as defined."""

    def step(batch: pa.RecordBatch) -> dict:
        found = statistics_of(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), **{n: np.asarray(found[n], float) for n in STATISTICS}}

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(texts(df, id_col, text_col), step, f"doc_id {kind}, " + ", ".join(f"{n} double" for n in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, is at most, bound) that must all hold."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        tests = [F.col(n) <= bound if at_most else F.col(n) > bound for n, at_most, bound in self.conditions]
        return reduce(lambda a, b: a & b, tests)


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1 as one column expression over the statistics."""
        total = sum((F.when(rule.column(), weight).otherwise(0.0) for rule, weight in self.rules), F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def tree_paths(forest_text: str, names: list[str]) -> list[Rule]:
    """The path to every node below a root, in the printed form of a tree model; each set of conditions once."""
    rules: dict[tuple, None] = {}
    path: list[tuple[str, bool, float]] = []
    for line in forest_text.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+\d.eE]+)\)", line)
        if not found:
            continue
        depth = len(found[1])
        path = [p for p in path if p[0] < depth]
        path.append((depth, (names[int(found[2])], found[3] == "<=", float(found[4]))))
        tightest: dict[tuple[str, bool], float] = {}
        for _, (name, at_most, bound) in path:
            have = tightest.get((name, at_most), bound)
            tightest[name, at_most] = min(have, bound) if at_most else max(have, bound)
        rules[tuple(sorted((n, a, b) for (n, a), b in tightest.items()))] = None
    return [Rule(r) for r in rules]


def fit_rules(labelled: DataFrame, trees: int = 20, depth: int = 3, lasso: float = 5e-4, seed: int = 7) -> RuleModel:
    """From STATISTICS and `label` (0 or 1). Without both labels there are no rules and every score is the share of label 1."""
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        share = min(1 - 1e-9, max(1e-9, float(next(iter(counts), 0.5))))
        return RuleModel((), float(np.log(share / (1 - share))))
    rows = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(labelled.withColumn("label", F.col("label").cast("double")))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="0.5", subsamplingRate=0.7, seed=seed).fit(rows.select("features", "label"))
    rules = tree_paths(forest.toDebugString, STATISTICS)
    if not rules:
        share = counts[1] / sum(counts.values())
        return RuleModel((), float(np.log(share / (1 - share))))
    hits = F.array(*[r.column().cast("double") for r in rules])
    from pyspark.ml.functions import array_to_vector

    held = cut_lineage(rows.select(array_to_vector(hits).alias("rules"), "label"))
    fit = LogisticRegression(featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(held)
    weights = fit.coefficients.toArray()
    return RuleModel(tuple((r, float(w)) for r, w in zip(rules, weights) if w), float(fit.intercept))


def score_quality(df: DataFrame, labels: DataFrame, label_col: str = "quality", learn_on: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
                  sample_rows: int = 50000) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 is likelier) of every whole text.

    Labels (id and 0/1 in `label_col`; null ones are left out, of repeated ones the highest holds) count where `learn_on`, a condition on the
    id, holds. The rules are fitted on about `sample_rows` labelled rows, chosen by a hash of the id. Null and empty texts are scored by
    their statistics like others. Repeated rows are scored each on its own; other columns are left out.
    """
    known = labels.select(col(id_col).alias("doc_id"), col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & (F.lit(True) if learn_on is None else learn_on))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = cut_lineage(text_statistics(df, id_col, text_col))
    share = min(1.0, sample_rows / max(1, known.count()))
    place = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) / (1 << 30)
    model = fit_rules(cut_lineage(rows.join(known.filter(place < share), "doc_id").select(*STATISTICS, "label")))
    return rows.select("doc_id", model.score().alias("score"))
