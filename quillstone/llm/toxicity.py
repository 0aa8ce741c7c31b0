"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity has the grades 0 to 3. Labels that hold grades are taken as they are. Labels that only say toxic or not have no
severity of their own: there a toxic row's grade is 1, 2 or 3 by how many different marker words it holds (under 3, under 6,
more), markers being the words whose log-odds between toxic and other rows are beyond doubt in the half of the sample that
the row isn't in, so that no row's words decide their own grade. The model is P(grade <= j) = sigmoid(threshold_j -
weights . x): one weight for each word shared by all thresholds, and thresholds that are kept in order by being sums of
positive steps. x has a one for each vocabulary word in the text, and for each beginning of four or five letters of its
words. The expected severity is the mean of the grade; the grade is its median, and a document is toxic if that is above 0.

Only the fit uses a sample: at most ``per_class`` toxic rows and twice as many others, those with the smallest hash of
their id, and the ``vocabulary`` words that tell most between them. The sample's words are counted where they are; one task
fits, on at most ``vocabulary`` numbers a row, and what reaches the driver is the model. All documents are scored, whole, in
a map over the scan; the model, of bounded size, travels with the function.

Defined results. Null and empty texts, and texts without known words, get the thresholds' own severity and aren't toxic.
Words of more than 64 characters aren't known. Repeated rows: one result each. Without labelled rows of both kinds every
severity is 0 and nothing is toxic. Labels that are null count as 0; of those that repeat or contradict each other the
highest counts. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, pick
from quillstone.shipping import ship

WORD = re.compile(r"\w+")
GRADES = 4
MARKS = (3, 6)


PREFIXES = (4, 5)
WORD_CHARS = 64
#: A word's log-odds, in standard errors, from which it is a marker.
BEYOND_DOUBT = 4


def words_of(text: str | None) -> set[str]:
    """The text's different words, and their beginnings, marked by an asterisk, which inflected forms share."""
    words = {w for w in WORD.findall(text.lower()) if len(w) <= WORD_CHARS} if text else set()
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in PREFIXES))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()

    def probabilities(self, words: set[str]) -> list[float]:
        """Of the grades 0 to 3."""
        if not self.thresholds:
            return [1.0] + [0.0] * (GRADES - 1)
        score = sum(self.weights[w] for w in words & self.weights.keys())
        up_to = [1 / (1 + np.exp(-np.clip(t - score, -60, 60))) for t in self.thresholds] + [1.0]
        return [float(b - a) for a, b in zip([0.0, *up_to], up_to, strict=False)]


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> Scratch:
    """grade, words, half of at most 3 * per_class labelled texts; their ids are the only side that is broadcast."""
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.greatest(F.coalesce(F.col("toxic").cast("int"), F.lit(0)), F.lit(0))).alias("grade"))
    ordered = [marked.where(kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for kind, n in (("grade > 0", per_class), ("grade = 0", 2 * per_class))]
    chosen = F.broadcast(ordered[0].unionByName(ordered[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sorted(words_of(t.as_py())) for t in batch.column(2)], pa.list_(pa.string()))], names=["grade", "half", "words"])

    rows = docs.join(chosen, "doc_id").select("grade", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half"), F.col("text").cast("string"))
    return Scratch.write(rows.mapInArrow(run, "grade int, half int, words array<string>"))


def telling(a: str, n_a: str, b: str, n_b: str) -> str:
    """SQL for a word's log-odds between a of n_a toxic rows and b of n_b others, in standard errors."""
    odds = f"(ln(({a} + 0.5) / ({n_a} - {a} + 0.5)) - ln(({b} + 0.5) / ({n_b} - {b} + 0.5)))"
    return f"{odds} / sqrt(1 / ({a} + 0.5) + 1 / ({n_a} - {a} + 0.5) + 1 / ({b} + 0.5) + 1 / ({n_b} - {b} + 0.5))"


def vocabulary_of(sample: DataFrame, size: int, least: int) -> list[tuple[str, bool, bool]]:
    """The words that tell most, at most ``size``, and whether each is a marker for rows of half 0 and of half 1, by the other half."""
    kinds = [f"{kind} AND half = {half}" for half in (0, 1) for kind in ("grade > 0", "grade = 0")]
    totals = sample.agg(*[F.count_if(F.expr(k)).alias(f"n{i}") for i, k in enumerate(kinds)]).first()
    n = [totals[f"n{i}"] for i in range(4)]
    if not n[0] + n[2] or not n[1] + n[3]:
        return []
    counts = sample.select("grade", "half", F.explode("words").alias("word")).groupBy("word").agg(*[F.count_if(F.expr(k)).alias(f"c{i}") for i, k in enumerate(kinds)])
    told = counts.where(f"c0 + c1 + c2 + c3 >= {least}").select(
        "word", F.expr(telling("(c0 + c2)", str(n[0] + n[2]), "(c1 + c3)", str(n[1] + n[3]))).alias("told"),
        F.expr(telling("c2", str(n[2]), "c3", str(n[3]))).alias("for_0"), F.expr(telling("c0", str(n[0]), "c1", str(n[1]))).alias("for_1"),
    )
    chosen = told.orderBy(F.abs("told").desc(), "word").limit(size).collect()  # at most ``size`` words
    return [(r["word"], r["for_0"] > BEYOND_DOUBT, r["for_1"] > BEYOND_DOUBT) for r in chosen]


def graded(toxic: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """Grades of rows that only say toxic or not, by their numbers of markers."""
    return np.where(toxic, 1 + sum((markers >= m).astype(int) for m in MARKS), 0)


def maximum_likelihood(grade: np.ndarray, row: np.ndarray, col: np.ndarray, v: int, penalty: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds for a one in each (row, col), with a quadratic penalty on the weights, by Adam over all rows."""
    n = len(grade)
    theta = np.concatenate([np.zeros(v), [1.0, 0.0, 0.0]])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    cuts_of = lambda raw: raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])
    for step in range(1, rounds + 1):
        weights, raw = theta[:v], theta[v:]
        score = np.bincount(row, weights[col], n)
        below = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(-np.clip(cuts_of(raw)[None, :] - score[:, None], -40, 40))), np.ones((n, 1))], axis=1)
        at = np.arange(n)
        upper, lower = below[at, grade + 1], below[at, grade]
        likely = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / likely, lower * (1 - lower) / likely
        d_score = d_upper - d_lower  # of the negative logarithm
        d_cuts = np.array([-(d_upper[grade == j].sum()) + d_lower[grade == j + 1].sum() for j in range(GRADES - 1)])
        steps = np.exp(raw[1:])
        gradient = np.concatenate([np.bincount(col, d_score[row], v) + penalty * weights, [d_cuts.sum()], [d_cuts[1:].sum() * steps[0], d_cuts[2:].sum() * steps[1]]]) / n
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        theta -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return theta[:v], cuts_of(theta[v:])


def fit(sample: DataFrame, most: int, vocabulary: int = 4096, least: int = 5) -> Model:
    """From rows of grade, half, words: the words are chosen by counts, then one task fits on numbers of words, of ``most`` rows at most."""
    known = vocabulary_of(sample, vocabulary, least)
    if not known:
        return Model()
    place = {w: k for k, (w, _, _) in enumerate(known)}
    marks = np.array([[m0, m1] for _, m0, m1 in known])

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[place[w] for w in words if w in place] for words in batch.column(2).to_pylist()], pa.list_(pa.int32()))], names=["grade", "half", "own"])

    def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades, halves, own = [], [], []
        for batch in batches:
            grades.append(batch.column(0).to_numpy())
            halves.append(batch.column(1).to_numpy())
            own += [np.array(x, np.int32) for x in batch.column(2).to_pylist()]
        grade, half = np.concatenate(grades).astype(np.int64), np.concatenate(halves)
        col = np.concatenate(own)
        row = np.repeat(np.arange(len(own)), [len(x) for x in own])
        if grade.max() == 1:
            grade = graded(grade > 0, np.bincount(row, marks[col, half[row]].astype(float), len(grade)))
        weights, cuts = maximum_likelihood(np.minimum(grade, GRADES - 1), row, col, len(place))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tolist()], pa.list_(pa.float64())), pa.array([cuts.tolist()], pa.list_(pa.float64()))], names=["weights", "cuts"])

    found = sample.mapInArrow(numbers, "grade int, half int, own array<int>").limit(most).repartition(1).mapInArrow(fitting, "weights array<double>, cuts array<double>").first()
    return Model(dict(zip(place, found["weights"], strict=True)), tuple(found["cuts"]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity (expected grade), grade (the median), p_toxic, toxic (grade above 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array([model.probabilities(words_of(t.as_py())) for t in batch.column(1)], np.float64).reshape(-1, GRADES)
            grade = (p.cumsum(axis=1) < 0.5).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p @ np.arange(GRADES)), pa.array(grade), pa.array(1 - p[:, 0]), pa.array(grade > 0)], names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    src = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, severity double, grade int, p_toxic double, toxic boolean")


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = 2000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    sample = labelled_sample(pick(docs, doc_id=id_col, text=text_col), pick(labels, doc_id=id_col, toxic=label_col), per_class)
    model = fit(sample.read(), 3 * per_class)
    sample.drop()
    return model


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose text isn't toxic; nothing is shuffled."""
    ship(docs.sparkSession)

    @F.pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        return pd.Series([model.probabilities(words_of(t))[0] < 0.5 for t in texts], dtype=bool)

    return docs.where(~toxic(F.col(f"`{text_col}`").cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> DataFrame:
    return score(docs, fitted(docs, labels, per_class))
