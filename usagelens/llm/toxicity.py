"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import free_name
from usagelens.llm.hashed_text import bounded_sample, hashed, placed, scored, screened

#: Bounds and settings of the fit: labelled rows, terms, texts a term must be in, factors, passes, step, decay.
ROWS, TERMS, LEAST_DOCS, FACTORS, EPOCHS, STEP, DECAY = 20_000, 1024, 5, 4, 8, 0.1, 2e-5
THRESHOLD, FOLDS, HELD_OUT = 0.3, 4, 2
_BATCH = 64


@dataclass(frozen=True)
class Machine:
    """bias + sum w_i + sum over pairs i < j of <v_i, v_j>, over the terms present in a text."""

    vocabulary: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def probability(self, where: np.ndarray) -> float:
        v = self.factors[where]
        pairs = 0.5 * ((v.sum(axis=0) ** 2) - (v**2).sum(axis=0)).sum()
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.linear[where].sum() + pairs, -30, 30))))


def fit(vocabulary: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """AdaGrad over small batches of texts; without rows of both labels the score is their share (0.5 without rows)."""
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        none = np.empty(0, np.int64)
        return Machine(none, float(np.log(share / (1 - share))), np.empty(0), np.empty((0, FACTORS)))
    y = labels.astype(float)
    random = np.random.default_rng(seed)
    w = np.zeros(len(vocabulary))
    v = random.normal(0, 0.01, (len(vocabulary), FACTORS))
    bias = float(np.log(y.mean() / (1 - y.mean())))
    gw, gv, gb = np.full(len(w), 1e-2), np.full(v.shape, 1e-2), 1e-2
    for _ in range(EPOCHS):
        order = random.permutation(len(rows))
        for start in range(0, len(order), _BATCH):
            part = order[start : start + _BATCH]
            lengths = [len(rows[k]) for k in part]
            at = np.concatenate([rows[k] for k in part])
            of = np.repeat(np.arange(len(part)), lengths)
            vs = v[at]
            total = np.stack([np.bincount(of, vs[:, f], len(part)) for f in range(FACTORS)], axis=1)
            square = np.bincount(of, (vs**2).sum(axis=1), len(part))
            z = bias + np.bincount(of, w[at], len(part)) + 0.5 * ((total**2).sum(axis=1) - square)
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]
            used, back = np.unique(at, return_inverse=True)
            dw = np.bincount(back, error[of], len(used)) / len(part) + DECAY * w[used]
            dv = error[of][:, None] * (total[of] - vs)
            dv = np.stack([np.bincount(back, dv[:, f], len(used)) for f in range(FACTORS)], axis=1) / len(part)
            dv += DECAY * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += error.mean() ** 2
            w[used] -= STEP * dw / np.sqrt(gw[used])
            v[used] -= STEP * dv / np.sqrt(gv[used])
            bias -= STEP * error.mean() / np.sqrt(gb)
    return Machine(vocabulary, bias, w, v)


def held_out(id_col):
    """True for the rows whose labels are never learned: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", rows=ROWS) -> Machine:
    """Fits on at most `rows` labelled texts outside the held-out quarter (those with the smallest id hashes).

    Rows without id, label or text teach nothing. Only this bounded sample's places in the vocabulary
    reach the driver.
    """
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).alias("label"))
    )
    # At most `rows` ids and labels, so small enough for every task.
    chosen = F.broadcast(bounded_sample(known, "id", rows))
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("text is not null")
    sample = hashed(texts.join(chosen, "id"), "text", "label")
    vocabulary = screened(sample, TERMS, LEAST_DOCS)
    places, _, _, y = placed(sample, vocabulary)
    return fit(vocabulary, places, y)


def score(docs: DataFrame, machine: Machine, out: str, text_col: str = "text") -> DataFrame:
    """Adds `out`, the probability of a toxic text, from the text alone.

    Null and empty texts get the score of a text without terms. Every row is scored where it lies: nothing is
    shuffled, repeated rows get equal scores, other columns stay. The name `out` must be free.
    """

    def predict(where, _counts, _tokens):
        return (machine.probability(where),)

    return docs.withColumn(out, scored(docs[text_col], machine.vocabulary, predict, "p double")["p"])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`doc_id, held_out, score, predicted` for every row; an empty table gives none. A null id is not held out."""
    plain = docs.select("doc_id", "text")
    return score(plain, train(docs, labels), "score").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows scored below the threshold, with their columns as they are; null and empty texts are never dropped."""
    name = free_name(docs, "toxic_score")
    empty = F.trim(F.coalesce(F.col("text"), F.lit(""))) == ""
    return score(docs, train(docs, labels), name).where((F.col(name) < threshold) | empty).drop(name)
