"""Quality grades by ordinal cumulative-link regression over hashed terms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.hashed_text import bounded_sample, hashed, placed, scored, screened

#: Bounds and settings of the fit: labelled rows, terms, texts a term must be in, passes, step, decay.
ROWS, TERMS, LEAST_DOCS, EPOCHS, STEP, DECAY = 20_000, 4096, 5, 8, 0.1, 1e-4
#: Grades are 0 to 2; a text is kept if it has at least grade 1 with this probability.
GRADES, KEEP_GRADE, KEEP_PROBABILITY = 3, 1, 0.5
_BATCH = 64


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _shares(counts: np.ndarray, tokens: int) -> np.ndarray:
    """How much of the text a term makes up, between 0 and 1, on a logarithmic scale."""
    return np.log1p(counts) / np.log(2.0 + tokens)


@dataclass(frozen=True)
class Ordinal:
    """P(grade > k) = sigmoid(w.x - cut_k), one weight vector, cuts in ascending order."""

    vocabulary: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, where: np.ndarray, counts: np.ndarray, tokens: int) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ...: falling, as the cuts ascend."""
        return _sigmoid(self.weights[where] @ _shares(counts, tokens) - self.cuts)


def fit(
    vocabulary: np.ndarray, places: list, counts: list, tokens: np.ndarray, grades: np.ndarray, seed: int = 7
) -> Ordinal:
    """Maximum likelihood by AdaGrad; the cuts are a first one and positive gaps, so their order holds by form.

    Without any rows all grades are equally likely.
    """
    levels = GRADES - 1
    above = np.array([(grades > k).sum() + 0.5 for k in range(levels)]) / (len(grades) + 1.0)
    start = np.maximum.accumulate(-np.log(above / (1 - above)) + 1e-3 * np.arange(levels))
    first, gaps = start[0], np.log(np.maximum(np.diff(start), 1e-3))
    w = np.zeros(len(vocabulary))
    if not len(vocabulary):
        return Ordinal(vocabulary, w, start)
    at_, x_ = places, [_shares(c, int(n)) for c, n in zip(counts, tokens)]
    random = np.random.default_rng(seed)
    gw, g1, gg = np.full(len(w), 1e-2), 1e-2, np.full(len(gaps), 1e-2)
    for _ in range(EPOCHS):
        order = random.permutation(len(grades))
        for s in range(0, len(order), _BATCH):
            part = order[s : s + _BATCH]
            y = grades[part]
            at = np.concatenate([at_[k] for k in part])
            x = np.concatenate([x_[k] for k in part])
            of = np.repeat(np.arange(len(part)), [len(at_[k]) for k in part])
            z = np.bincount(of, w[at] * x, len(part))
            cuts = first + np.r_[0.0, np.cumsum(np.exp(gaps))]
            tail = np.c_[np.ones(len(part)), _sigmoid(z[:, None] - cuts), np.zeros(len(part))]
            slope = tail * (1 - tail)
            k = np.arange(len(part))
            likely = np.maximum(tail[k, y] - tail[k, y + 1], 1e-9)
            # Derivatives of -log P(y): by z, and by each cut.
            dz = -(slope[k, y] - slope[k, y + 1]) / likely
            dcut = np.zeros((len(part), levels + 2))
            dcut[k, y] += slope[k, y] / likely
            dcut[k, y + 1] -= slope[k, y + 1] / likely
            dcut = dcut[:, 1:-1].mean(axis=0)
            used, back = np.unique(at, return_inverse=True)
            dw = np.bincount(back, dz[of] * x, len(used)) / len(part) + DECAY * w[used]
            gw[used] += dw**2
            w[used] -= STEP * dw / np.sqrt(gw[used])
            d1 = dcut.sum()
            g1 += d1**2
            dg = np.exp(gaps) * np.cumsum(dcut[::-1])[::-1][1:]
            gg += dg**2
            first -= STEP * d1 / np.sqrt(g1)
            gaps = gaps - STEP * dg / np.sqrt(gg)
    return Ordinal(vocabulary, w, first + np.r_[0.0, np.cumsum(np.exp(gaps))])


def train(docs: DataFrame, ratings: DataFrame, id_col="doc_id", text_col="text", rows: int = ROWS) -> Ordinal:
    """Fits on at most `rows` of `ratings(id, grade)`; rows without id, grade or text teach nothing."""
    known = (
        ratings.where(F.col(id_col).isNotNull() & F.col("grade").isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min("grade").alias("grade"))
    )
    # At most `rows` ids and grades, so small enough for every task.
    chosen = F.broadcast(bounded_sample(known, "id", rows))
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("text is not null")
    sample = hashed(texts.join(chosen, "id"), "text", "grade")
    vocabulary = screened(sample, TERMS, LEAST_DOCS)
    return fit(vocabulary, *placed(sample, vocabulary))


def graded(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, `expected_grade`, `tail_probability` of the keeping grade and `kept`, for every row.

    Every row is scored where it lies. Null and empty texts have no terms: their grade follows from the cuts, and
    they are not kept. Repeated rows get equal results, a null id stays null, an empty table gives no rows, other
    columns are not read.
    """

    def predict(where, counts, tokens):
        tails = model.tails(where, counts, tokens)
        return float(tails.sum()), float(tails[KEEP_GRADE - 1]), float(tokens)

    plain = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    s = scored(F.col("text"), model.vocabulary, predict, "grade double, tail double, tokens double")
    return plain.withColumn("s", s).select(
        F.col("id").alias(id_col),
        F.col("s.grade").alias("expected_grade"),
        F.col("s.tail").alias("tail_probability"),
        ((F.col("s.tail") >= KEEP_PROBABILITY) & (F.col("s.tokens") > 0)).alias("kept"),
    )


def grades_of(labels: DataFrame) -> DataFrame:
    """Ratings in three grades from the two marks: 0 poor, 1 sound but toxic, 2 sound."""
    return labels.select(
        "doc_id",
        F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, 2 - F.coalesce("toxic", F.lit(0))).alias("grade"),
    )
