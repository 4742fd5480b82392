import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, frame
from usagelens.llm import katz, queries

END, START = object(), object()


class Plain:
    """Katz backoff of order two in dictionaries."""

    def __init__(self, texts):
        self.texts = len(texts)
        self.words, self.pairs = Counter(), Counter()
        for t in texts:
            tokens = self.tokens(t)
            self.words.update(tokens)
            self.pairs.update(zip([START, *tokens], tokens))
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.d1, self.d2 = (self.factors(Counter(c.values())) for c in (self.words, self.pairs))
        freed = sum((1 - self.d1[c]) * c for c in self.words.values() if c <= 5)
        self.total = self.n if freed > 0 else self.n + 1
        self.unknown = (freed if freed > 0 else 1) / self.total
        self.followers = {}
        for (a, b), c in self.pairs.items():
            self.followers.setdefault(a, {})[b] = c

    @staticmethod
    def tokens(text):
        return [*(text or "").encode().lower().split(), END]

    @staticmethod
    def factors(n):
        for k in (5, 4, 3, 2):
            if all(n[r] for r in range(1, k + 2)):
                a = (k + 1) * n[k + 1] / n[1]
                if a == 1:
                    continue
                d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, k + 1)}
                if all(0 < x <= 1 for x in d.values()):
                    return {r: d.get(r, 1.0) for r in range(6)}
        return dict.fromkeys(range(6), 1.0)

    def word(self, w):
        c = self.words[w]
        return self.d1.get(c, 1.0) * c / self.total if c else self.unknown

    def given(self, w, before):
        seen = self.followers.get(before)
        if not seen:
            return self.word(w)
        freed = sum((1 - self.d2.get(c, 1.0)) * c for c in seen.values())
        total = sum(seen.values()) + (freed == 0)
        if w in seen:
            return self.d2.get(seen[w], 1.0) * seen[w] / total
        return (freed or 1) / total / (1 - sum(map(self.word, seen))) * self.word(w)

    def score(self, text):
        tokens = self.tokens(text)
        base = sum(math.log10((self.words[t] + 1) / (self.n + self.v + 1)) for t in tokens)
        known = sum(self.words[t] > 0 for t in tokens)
        return len(tokens), known, self.n, base, sum(math.log10(self.given(b, a)) for a, b in zip([START, *tokens], tokens))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def prose(seed, texts=400):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(600)]
    weights = [1 / (i + 1) for i in range(600)]
    return [(i, " ".join(pick.choices(words, weights, k=pick.randint(0, 60)))) for i in range(texts)]


def check(spark, rows, clashing=False, **settings):
    model = Plain([t for i, t in rows if not held(i)])
    docs = frame(spark, rows, clashing)
    got = katz.katz_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2, **settings).collect()
    want = sorted(((i, held(i), *model.score(t)) for i, t in rows), key=str)
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=str), want):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9, atol=1e-9)
    return model


@pytest.mark.parametrize("chunk, chars", [(1 << 22, 1 << 24), (700, 1 << 24), (50, 400)])
def test_against_dictionaries(spark, chunk, chars):
    """In one chunk and bucket or in many: the frequent words are then dealt by both words of a pair."""
    check(spark, prose(1), chunk_tokens=chunk, bucket_chars=chars)


def test_probabilities_sum_to_one(spark):
    model = check(spark, prose(2))
    assert any(x < 1 for x in model.d1.values()) and any(x < 1 for x in model.d2.values())
    for before in [START, b"never seen", *list(model.words)[:40]]:
        assert abs(sum(model.given(w, before) for w in [*model.words, b"unknown"]) - 1) < 1e-9


@pytest.mark.parametrize("clashing", [False, True])
def test_awkward_rows(spark, clashing):
    check(spark, awkward(), clashing, chunk_tokens=100)


def test_nothing_to_learn_from(spark):
    """All texts held out: every token is unknown."""
    ids = [i for i in range(60) if held(i)][:3]
    check(spark, [(i, "some text") for i in ids])
    assert katz.katz_scores(frame(spark, []), F.lit(False)).collect() == []


def test_discounts():
    assert (katz.discounts([0] * 6) == 1).all()
    d = katz.discounts([3600, 900, 400, 225, 144, 100])
    assert d[0] == 1 and (np.diff(d[1:]) > 0).all() and 0 < d[1] < 1
    # Katz's constraint: what is freed is what was counted once.
    freed = sum(n * r * (1 - x) for r, n, x in zip(range(1, 6), [3600, 900, 400, 225, 144], d[1:]))
    assert abs(freed - 3600) < 1e-6


def test_better_than_the_plain_model(spark):
    """Held-out texts of a source with structure are likelier by pairs than by words alone."""
    pick, rows = random.Random(3), []
    for i in range(500):
        w, text = pick.randrange(200), []
        for _ in range(40):
            w = (w * 7 + pick.randrange(3)) % 200
            text.append(f"x{w}")
        rows.append((i, " ".join(text)))
    got = katz.katz_scores(frame(spark, rows), F.crc32(F.col("doc_id").cast("string")) % 7 == 2).where("held_out")
    assert got.where("score < base_score").count() == 0 and got.count() > 40


def test_query_against_dictionaries(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    model = Plain([t for i, t in rows if not held(i)])
    got = {r.doc_id: r for r in queries.op11_katz_scores(spark, folder).collect()}
    for i, t in rows:
        assert tuple(got[i])[1:5] == (held(i), *model.score(t)[:3])
        assert np.allclose(tuple(got[i])[5:], model.score(t)[3:], rtol=1e-9)
