import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import Union, awkward, frame
from usagelens.llm import exact_dedup, simhash
from usagelens.llm.components import components


def lowered(text):
    return (text or "").encode().lower().decode()


@pytest.mark.parametrize("clashing", [False, True])
def test_exact_duplicates(spark, clashing):
    rows = awkward()
    got = exact_dedup.exact_duplicates(frame(spark, rows, clashing)).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    stays = {}
    for r in got:
        body = next(b for b in groups if hashlib.sha256(b.encode()).hexdigest() == r.text_sha256)
        ids = [i for i in groups[body] if i is not None]
        assert r.group_size == len(groups[body]) and r.keep_id == max(ids, default=None)
        stays.setdefault(body, []).extend([r.doc_id] * r.kept)
    assert stays == {b: [max((i for i in ids if i is not None), default=None)] for b, ids in groups.items()}


def test_exact_duplicates_empty(spark):
    assert exact_dedup.exact_duplicates(frame(spark, [])).collect() == []


def plain_fingerprint(text, words=3):
    w = lowered(text).encode().split()
    grams = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("clashing", [False, True])
def test_near_duplicates(spark, clashing):
    rows = awkward()
    got = simhash.near_duplicates(frame(spark, rows, clashing)).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    sets = Union(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                sets.join(i, j)
    want = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if sets[j] == sets[k] and rows[j][0] is not None]
        want.append((i, f"{prints[k]:016x}", min(ids, default=None)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got)
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


@pytest.mark.parametrize("limit", [1, 4, 4096])
def test_every_near_pair_is_connected(spark, limit):
    pick = random.Random(5)
    prints = []
    for _ in range(60):
        base = pick.getrandbits(64)
        prints.append(base)
        for _ in range(pick.randint(0, 4)):
            other = base
            for bit in pick.sample(range(64), pick.randint(1, 4)):
                other ^= 1 << bit
            prints.append(other)
    # A dense group around one fingerprint, as near copies make it.
    base = pick.getrandbits(64)
    prints += [base ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = simhash.near_fingerprints(df, 3, limit)
    for r in links.collect():
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 9  # a star's rim
    roots = {r.node: r.root for r in components(links).collect()}
    sets = Union(len(prints))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                sets.join(i, j)
    want = {}
    for k, p in enumerate(signed):
        want.setdefault(sets[k], set()).add(p)
    found = {}
    for p in signed:
        found.setdefault(roots.get(p, p), set()).add(p)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, found.values()))


@pytest.mark.parametrize("clashing", [False, True])
def test_drop_near_duplicates_keeps_one_of_each(spark, clashing):
    docs = frame(spark, awkward(), clashing)
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    rows = awkward()
    prints = [plain_fingerprint(t, 5) for _, t in rows]
    sets = Union(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                sets.join(i, j)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(sets[k], []).append(i)
    want = [min((i for i in ids if i is not None), default=None) for ids in groups.values()]
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in out.collect())


def test_components_of_a_long_chain(spark):
    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in components(links).collect()} == {0}
    assert components(links.limit(0)).collect() == []
