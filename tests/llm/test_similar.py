import random

import pytest

from tests.llm.helpers import Union, awkward, frame
from usagelens.llm import similar, simhash
from usagelens.llm.components import components


def grams(text, n=5):
    w = (text or "").split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def likeness(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 0


def edited(pick, words, edits):
    words = list(words)
    for _ in range(edits):
        words[pick.randrange(len(words))] = f"x{pick.randrange(10**6)}"
    return words


def families(seed, copies, length=200):
    """Texts with copies of one to twelve changed words, and texts of their own."""
    pick = random.Random(seed)
    rows = []
    for _ in range(12):
        base = [f"w{pick.randrange(4000)}" for _ in range(length)]
        rows.append(" ".join(base))
        rows += [" ".join(edited(pick, base, pick.randint(1, 12))) for _ in range(copies)]
    pick.shuffle(rows)
    return list(enumerate(rows))


def classes(rows, least=0.8):
    sets = Union(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if likeness(rows[i][1], rows[j][1]) >= least:
                sets.join(i, j)
    return sets


def test_links_join_the_classes_of_brute_force(spark):
    rows = families(3, 9)
    links = similar.similar_links(spark.createDataFrame(rows, "node long, text string"))
    for r in links.collect():
        assert likeness(rows[r.a][1], rows[r.b][1]) >= 0.8
    roots = {r.node: r.root for r in components(links).collect()}
    sets = classes(rows)
    assert {i: roots.get(i, i) for i in range(len(rows))} == {i: sets[i] for i in range(len(rows))}


def test_large_buckets_keep_their_links(spark):
    pick = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(edited(pick, base, 3))) for i in range(150)]
    links = similar.similar_links(spark.createDataFrame(rows, "node long, text string"), paired=4).collect()
    assert len(links) <= 150 * 2 * similar.BANDS
    sets = Union(len(rows))
    for r in links:
        sets.join(r.a, r.b)
    assert {sets[i] for i in range(len(rows))} == {0}


def template(texts, pairs, length=300, own=0.14, seed=4):
    """Texts that share most of their words, at a similarity just below the bound; some have a true partner."""
    pick = random.Random(seed)
    base = [f"w{i}" for i in range(length)]
    cut = int(length * (1 - own))
    rows = []
    for k in range(texts):
        tail = [f"t{k}-{i}" for i in range(length - cut)]
        rows.append(base[:cut] + tail)
    for k in range(pairs):
        # The partner differs in its last words only.
        keep = len(rows[k]) - int(length * 0.09)
        rows.append(rows[k][:keep] + [f"p{k}-{i}" for i in range(length - keep)])
    pick.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("paired", [8, 32])
def test_pairs_hidden_in_a_template_are_found(spark, paired):
    """All texts share nearly all large buckets and none is similar to a centre: only the true pairs link."""
    rows = template(200, 60)
    links = similar.similar_links(spark.createDataFrame(rows, "node long, text string"), paired=paired)
    want, got = classes(rows), Union(len(rows))
    for r in links.collect():
        assert likeness(rows[r.a][1], rows[r.b][1]) >= 0.8
        got.join(r.a, r.b)
    assert sum(want[i] != i for i in range(len(rows))) == 60
    assert [got[i] for i in range(len(rows))] == [want[i] for i in range(len(rows))]


def test_two_families_in_one_bucket(spark):
    """Both share a template; each is many near copies; a text of one is linked to a text of none."""
    pick = random.Random(6)
    shared = [f"w{i}" for i in range(200)]
    rows = []
    for f in range(2):
        own = shared + [f"f{f}-{i}" for i in range(80)]
        rows += [own[:200] + edited(pick, own[200:], pick.randint(0, 3)) for _ in range(120)]
    rows += [r + [f"tail{i}" for i in range(8)] for r in rows[:5]]
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    links = similar.similar_links(spark.createDataFrame(rows, "node long, text string"), paired=6).collect()
    # A pair per node and centre, and trees per block, never the pairs of a family (14,280).
    assert len(links) < similar.BANDS * len(rows)
    want, got = classes(rows), Union(len(rows))
    for r in links:
        got.join(r.a, r.b)
    assert [got[i] for i in range(len(rows))] == [want[i] for i in range(len(rows))]


def test_a_chain_through_a_dropped_text(spark):
    """The ends of a chain are not similar; what links them is the nearest copy of the first, which goes itself."""
    base = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:399] + ["x"]))]
    step = base[:399] + ["x"]
    for k in range(5):
        step = step[30:] + [f"n{k}-{i}" for i in range(30)]
        rows.append((3 + k, " ".join(step)))
    texts = [t for _, t in rows]
    assert likeness(texts[0], texts[2]) >= 0.8 > likeness(texts[0], texts[3]) and likeness(texts[0], texts[-1]) < 0.5
    assert [r.doc_id for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()] == [1]


@pytest.mark.parametrize("clashing", [False, True])
def test_one_of_each_class_stays(spark, clashing):
    rows = families(5, 4)
    docs = frame(spark, rows, clashing)
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    sets = classes(rows)
    assert sorted(r.doc_id for r in out.collect()) == sorted({sets[i] for i in range(len(rows))})


def test_awkward_rows_and_none(spark):
    """Copies link whatever the case of A-Z; texts without words link to nothing."""
    assert similar.similar_links(spark.createDataFrame([], "node long, text string")).collect() == []
    rows = [(k, t) for k, (_, t) in enumerate(awkward())]
    got = Union(len(rows))
    for r in similar.similar_links(spark.createDataFrame(rows, "node long, text string")).collect():
        got.join(r.a, r.b)
    want = classes([(k, (t or "").encode().lower().decode()) for k, t in rows])
    assert [got[k] for k in range(len(rows))] == [want[k] for k in range(len(rows))]
