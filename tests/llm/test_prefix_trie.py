import hashlib
import random
import zlib

import pytest

from tests.llm.helpers import CLASHING
from usagelens.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The whole trie by nested loops, from the contract's words."""
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append((t is not None, t or 0, role, digest, text))
    first = {c: [(r, x) for *_, r, _, x in sorted(v)] for c, v in turns.items()}
    grown = {}
    for c, own in first.items():
        h = zlib.crc32(str(c).encode()) % 4
        grown[c] = tuple(first.get(c - c % 20, [])[:h] + own[h:])
    nodes = {}
    for c, seq in grown.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        kids = children.get(p, [])
        leaves[p] = sum(leaves[k] for k in kids) or 1
        words = len(p[-1][1].encode().split()) if p else 0
        saved[p] = (len(nodes[p]) - 1) * words + sum(saved[k] for k in kids)
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if grown[c] == p)
        up = min(nodes[p[:-1]]) if p else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members), len(p), up, len(members), len(children.get(p, [])), leaves[p], saved[p], digest))
    return sorted(map(str, out))


def got(spark, rows, clashing=False):
    table = spark.createDataFrame(rows, SCHEMA)
    if clashing:
        table = table.selectExpr("*", *(f"'x' AS {c}" for c in (*CLASHING, "conv", "place", "depth", "piece", "a", "pa")))
    out = prefix_trie.prefix_trie(*prefix_trie.branched(prefix_trie.turns_of(table)))
    return sorted(str(tuple(r)) for r in out.collect())


def talk(seed, convs, longest, said=3):
    pick = random.Random(seed)
    rows = []
    for c in pick.sample(range(200), convs):
        rows += [(c, t, pick.choice(["user", "assistant"]), pick.choice(["a b", "c", "d e f"][:said])) for t in range(pick.randint(1, longest))]
    return rows


@pytest.mark.parametrize("seed, convs, longest", [(1, 60, 5), (2, 40, 40), (3, 3, 300)])
def test_against_nested_loops(spark, seed, convs, longest):
    rows = talk(seed, convs, longest)
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("clashing", [False, True])
def test_awkward_rows(spark, clashing):
    rows = [
        (20, None, "user", "null turn first"),
        (20, 0, None, "no role"),
        (20, 1, "user", None),
        (20, 1, "user", None),
        (20, 2, "user", ""),
        (21, 0, "user", "only one turn, taken from its family"),
        (22, 5, "b", "tie"),
        (22, 5, "a", "tie"),
        (22, 5, "a", "another tie"),
        (41, 0, "user", "no family here"),
        (42, 0, "user", "word " * 60_000),
        (None, 0, "user", "no conversation"),
        *((63, 0, "user", "again") for _ in range(5)),
    ]
    assert got(spark, rows, clashing) == plain(rows)


def test_empty(spark):
    assert got(spark, []) == []


def test_long_chains_and_many_copies(spark):
    """A chain over several blocks; a node at which conversations from several blocks of ids end."""
    rows = [(0, t, "user", f"w{t % 7}") for t in range(2600)]
    rows += [(c, 0, "user", "same") for c in range(1, 9000, 3)]
    assert got(spark, rows) == plain(rows)
