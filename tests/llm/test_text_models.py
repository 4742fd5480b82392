import random
import zlib

import pytest
import sentencepiece

from tests.llm.helpers import awkward, frame
from usagelens.llm import pieces, quality, toxicity
from usagelens.llm.common import table

FOLDER = "/root/testdata/sf0.1"


def area(scores, labels):
    order = sorted(zip(scores, labels))
    ranks = [k for k, (_, y) in enumerate(order, 1) if y]
    n = len(ranks)
    return (sum(ranks) - n * (n + 1) / 2) / (n * (len(order) - n))


def test_toxicity_on_held_out_labels(spark):
    out = toxicity.toxicity(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels"))
    rows = out.join(table(spark, FOLDER, "labels"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert area([r.score for r in rows], [r.toxic for r in rows]) > 0.95
    caught = [r.predicted for r in rows if r.toxic]
    clean = [r.predicted for r in rows if not r.toxic]
    assert sum(caught) / len(caught) > 0.85 and sum(clean) / len(clean) < 0.02


def test_pairs_are_learned(spark):
    """Neither word alone is toxic: only a model of pairs can tell."""
    rows, labels = [], []
    for k in range(1200):
        a, b = k % 2, k // 2 % 2
        text = " ".join(["plain", "words"] + ["insult"] * a + ["group"] * b + [f"w{k % 7}"])
        rows.append((k, text))
        labels.append((k, 1, a & b))
    docs = frame(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    both, one = (toxicity.score(frame(spark, [(1, t)]), model, "p").first().p for t in ("insult group", "insult words"))
    assert both > 0.5 > one


@pytest.mark.parametrize("clashing", [False, True])
def test_awkward_rows_are_scored(spark, clashing):
    rows = awkward()
    docs = frame(spark, rows, clashing)
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert all(r.predicted == (r.score >= 0.3) for r in out)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    graded = quality.graded(docs, quality.train(docs, quality.grades_of(labels))).collect()
    assert len(graded) == len(rows) and not any(r.kept for r in graded if r.doc_id in (6, 7, 8))
    none = labels.limit(0)
    empty = frame(spark, [])
    assert toxicity.toxicity(empty, none).collect() == []
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.5}
    assert quality.graded(empty, quality.train(empty, quality.grades_of(none))).collect() == []


def test_quality_orders_the_grades(spark):
    docs, labels = table(spark, FOLDER, "documents"), quality.grades_of(table(spark, FOLDER, "labels"))
    fold = "crc32(cast(cast(doc_id as string) as binary)) % 4"
    model = quality.train(docs, labels.where(f"{fold} <> 1"))
    assert list(model.cuts) == sorted(model.cuts)
    rows = quality.graded(docs, model).join(labels.where(f"{fold} = 1"), "doc_id").collect()
    assert area([r.expected_grade for r in rows], [r.grade > 0 for r in rows]) > 0.9
    assert sum(r.kept for r in rows if r.grade == 2) / sum(r.grade == 2 for r in rows) > 0.97
    assert sum(r.kept for r in rows if r.grade == 0) / sum(r.grade == 0 for r in rows) < 0.4


def test_pieces_without_dropout_are_sentencepiece_s(spark):
    processor = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    docs = frame(spark, [(i, t) for i, t in awkward() if t and "▁" not in t] + [(50, "x" * 300 + "  ab\n\n" + "ab" * 99)])
    texts = {r.doc_id: r.text for r in docs.where("doc_id is not null and doc_id <> 12").collect()}
    for r in pieces.encode(docs.where("doc_id is not null and doc_id <> 12"), dropout=0.0).collect():
        assert r.ids == processor.encode(texts[r.doc_id])


@pytest.mark.parametrize("clashing", [False, True])
def test_pieces_come_back_whole(spark, clashing):
    rows = awkward()
    docs = frame(spark, rows, clashing)
    with open(pieces.MODEL, "rb") as f:
        model = f.read()
    coded = pieces.encode(docs, dropout=0.3)
    back = coded.select("doc_id", "lossless", pieces.decoded(coded["ids"], model).alias("text")).collect()
    assert all(r.lossless for r in back)
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in rows)
    assert pieces.encode(frame(spark, [])).collect() == []
    again = pieces.encode(docs, dropout=0.3)
    assert sorted(map(str, coded.collect())) == sorted(map(str, again.collect()))


def test_dropout_varies_and_long_chunks_agree():
    with open(pieces.MODEL, "rb") as f:
        model = f.read()
    own = pieces.Pieces(model)
    words = [" " + w * k for w in ("theother", "naïve", "chäüß", "x") for k in (1, 2, 5)]
    short = pieces.encode_chunks(words, [1] * len(words), own, 0.3, 5)
    before, pieces.LONG = pieces.LONG, 0
    try:
        assert pieces.encode_chunks(words, [1] * len(words), own, 0.3, 5) == short
    finally:
        pieces.LONG = before
    assert len({tuple(pieces.encode_chunks([" theothertion"], [d], own, 0.3, 5)) for d in range(30)}) > 3


def test_every_occurrence_is_drawn_for_itself(spark):
    """More segmentations than a handful, inside a document and between documents, at the dropout asked for."""
    with open(pieces.MODEL, "rb") as f:
        own = pieces.Pieces(f.read())
    word = "theothertion"
    docs = frame(spark, [(i, " ".join([word] * 200)) for i in range(40)])
    split = {}
    for r in pieces.encode(docs).collect():
        words = " ".join(own.names[i] for i in r.ids).split(" " + pieces.SPACE)
        split[r.doc_id] = [w.lstrip(pieces.SPACE) for w in words]
    assert len({tuple(x) for x in split.values()}) == 40
    assert all(len(set(x)) > 4 for x in split.values())
    # As often as in independent draws, an occurrence has its undropped pieces.
    word_alone = [" " + word]
    plain = pieces.encode_chunks(word_alone, [0], own, 0.0, 5)[0]
    name = " ".join(own.names[i] for i in pieces.np.frombuffer(plain, pieces.np.int32)).lstrip(pieces.SPACE)
    same = [w == name for x in split.values() for w in x]
    drawn = pieces.encode_chunks(word_alone * 8000, list(range(8000)), own, pieces.DROPOUT, 5)
    assert abs(sum(same) / len(same) - sum(x == plain for x in drawn) / len(drawn)) < 0.04
    # What is taken from kept paths is what encoding the occurrence by itself gives, however often it came before.
    texts, limit = [f"a {word}  naïve x\n{'ab' * 60} {word}"] * 3, pieces._limit(0.3)
    coder, seen = pieces.Encoder(open(pieces.MODEL, "rb").read(), 0.3, 5), []

    def by_itself(self, flat, keys):
        seen.append(keys)
        return pieces.np.zeros(len(flat), int), pieces.np.arange(len(flat))

    kept, pieces.Encoder._paths = pieces.Encoder._paths, by_itself
    try:
        alone = [coder(texts, marks) for marks in ([1, 2, -3], [4, 5, 6])]
    finally:
        pieces.Encoder._paths = kept
    assert len(seen[0]) == 3 * len(pieces.split(texts[0])) and limit == coder.limit
    for _ in range(3):
        assert [coder(texts, marks) for marks in ([1, 2, -3], [4, 5, 6])] == alone


def plain_agenda(chunk, key, own, limit):
    """One chunk, one candidate after the other, in a list."""
    parts = [(at, p if (p := int(own.of_point[ord(c)])) >= 0 else -1 - ord(c)) for at, c in enumerate(chunk)]
    skipped = set()
    while True:
        found = []
        for k in range(len(parts) - 1):
            (at, a), (_, b) = parts[k], parts[k + 1]
            made = own.merge.get((a, b))
            if made is not None and (at, a, b) not in skipped:
                found.append((int(own.rank[made]), at, k, a, b, made))
        if not found:
            return [p for _, p in parts]
        _, at, k, a, b, made = min(found)
        code = pieces.np.array([key ^ (a << 40) ^ (b << 20) ^ at], pieces.np.uint64)
        if int(pieces._mixed(code)[0]) < limit:
            skipped.add((at, a, b))
        else:
            parts[k : k + 2] = [(at, made)]


def test_pieces_against_a_plain_agenda():
    with open(pieces.MODEL, "rb") as f:
        model = f.read()
    own, limit = pieces.Pieces(model), pieces._limit(0.3)
    pick = random.Random(4)
    words = [" theothertion", " naïve", "  the", " " + "ab" * 20, " international", "x", " the"]
    chunks = [pick.choice(words) for _ in range(600)]
    keys = pieces.np.array([pick.getrandbits(64) for _ in chunks], pieces.np.uint64)
    want = [plain_agenda(c, int(k), own, limit) for c, k in zip(chunks, keys)]
    got = pieces.encode_keyed(chunks, keys, own, limit)
    assert [pieces.np.frombuffer(g, pieces.np.int32).tolist() for g in got] == want
    coder, left = pieces.Encoder(model, 0.3, 5), []
    for _ in range(16):
        path, alone = coder._paths(chunks, keys)
        held = [pieces.np.frombuffer(coder.plain[p], pieces.np.int32).tolist() for p in path]
        rest = set(alone.tolist())
        assert all(h == w for k, (h, w) in enumerate(zip(held, want)) if k not in rest)
        left.append(len(rest))
    assert left[-1] < left[0] / 5
    # Whole by chunks is whole by decoding the text.
    texts = ["a b  c\n", "▁ x ▁", "", " ", "naïve 😀 \u0000"]
    ids, whole = coder(texts, [1, 2, 3, 4, 5])
    assert whole == [pieces.decode_ids(pieces.np.frombuffer(i, pieces.np.int32), own) == t for i, t in zip(ids, texts)]
    assert pieces._decode_to([ids[0]], ["another"], own).tolist() == [False]
