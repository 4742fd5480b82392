"""Trie of conversations' prefixes, with subtree totals by parallel tree contraction.

Turns are reduced to digests where they are read, so no text is moved. A prefix is named by sums of hashes of its
turns and their places, which are worked out in blocks: neither a very long conversation nor a node that most
conversations share is handled by one task. Contraction takes rounds of two joins each, their number growing with the
logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.llm.common import written

#: Turns of a conversation that are summed up in one group, and conversation ids that are joined in one group.
BLOCK = 1024
ID_BLOCK = 4096
WORD = "[^\\x20\\x09-\\x0D]+"
_SUMS = ["s0", "s1", "s2", "s3"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """`conv, place, body, words`: each conversation's turns in order, from place 1, without their texts.

    Order is the turn number (null first), then the role, then the MD5 of role and text; null roles and texts are
    empty. Rows without a conversation id are left out; repeated rows are turns of their own. Rows are sorted across
    the cluster and counted per piece, so a conversation may be of any length.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("body"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = ["conv", "turn", "role", "body"]
    pieces = written(rows.repartitionByRange(*order).withColumn("piece", F.spark_partition_id()), "turns")
    here = Window.partitionBy("conv", "piece").orderBy(*order[1:])
    before = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.groupBy("conv", "piece").agg(F.count("*").alias("n"))
    starts = starts.select("conv", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = pieces.withColumn("rank", F.row_number().over(here)).join(starts, ["conv", "piece"])
    return ranked.select("conv", (F.col("rank") + F.col("start")).alias("place"), "body", "words")


def branched(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of conversations rebuilt on their family's beginning.

    Conversation c takes the first h turns of conversation `c - c % family` (all if it has fewer, none if it isn't
    there), h being the CRC-32 of its decimal id modulo `most`, and goes on with its own turns after its first h.
    """
    turns = written(turns, "ranked")
    h = (F.crc32(F.col("conv").cast("string")) % most).alias("h")
    lengths = turns.groupBy("conv").agg(F.max("place").alias("length"))
    convs = lengths.select("conv", h, (F.col("conv") - F.col("conv") % family).alias("first"))
    parents = lengths.select(F.col("conv").alias("first"), "length")
    grown = convs.join(parents, "first", "left").select(
        "conv", "h", "first", F.least("h", F.coalesce("length", F.lit(0))).alias("taken")
    )
    grown = written(grown, "grown")
    heads = turns.where((F.col("conv") % family == 0) & (F.col("place") < most)).withColumnRenamed("conv", "first")
    heads = grown.join(heads, "first").where("place <= h").select("conv", "place", "body", "words")
    tails = turns.select("*", h).where("place > h").join(grown.select("conv", "taken"), "conv")
    tails = tails.select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "body", "words")
    return heads.unionByName(tails), grown.select("conv")


def _key(place: Column, sums: list[Column]) -> list[Column]:
    return [F.xxhash64(place, *sums), F.xxhash64(F.lit(1), *reversed(sums), place)]


def memberships(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """`conv, depth, key(a, b), parent key(pa, pb), words` for every conversation and prefix of it, the empty one too."""
    halves = [F.xxhash64("place", "body"), F.xxhash64(F.lit(1), "body", "place")]
    low, up = F.lit(0xFFFFFFFF).cast("long"), 32
    own = [p for x in halves for p in (x.bitwiseAND(low), F.shiftrightunsigned(x, up))]
    rows = turns.select("conv", "place", "words", *(c.alias(f"h{i}") for i, c in enumerate(own)))
    rows = rows.withColumn("block", F.floor(F.col("place") / BLOCK))
    run = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "block").agg(*(F.sum(f"h{i}").alias(f"b{i}") for i in range(4)))
    blocks = blocks.select(
        "conv", "block", *(F.coalesce(F.sum(f"b{i}").over(before), F.lit(0)).alias(f"b{i}") for i in range(4))
    )
    summed = rows.select("*", *(F.sum(f"h{i}").over(run).alias(f"r{i}") for i in range(4))).join(blocks, ["conv", "block"])
    summed = summed.select("*", *((F.col(f"r{i}") + F.col(f"b{i}")).alias(s) for i, s in enumerate(_SUMS)))
    above = [F.col(s) - F.col(f"h{i}") for i, s in enumerate(_SUMS)]
    a, b = _key(F.col("place").cast("long"), [F.col(s) for s in _SUMS])
    pa_, pb = _key((F.col("place") - 1).cast("long"), above)
    nodes = summed.select(
        "conv",
        F.col("place").cast("long").alias("depth"),
        a.alias("a"),
        b.alias("b"),
        pa_.alias("pa"),
        pb.alias("pb"),
        "words",
    )
    zero = [F.lit(0).cast("long")] * 4
    a, b = _key(F.lit(0).cast("long"), zero)
    none = F.lit(None).cast("long")
    roots = convs.select(
        "conv", F.lit(0).cast("long").alias("depth"), a.alias("a"), b.alias("b"), none.alias("pa"), none.alias("pb"),
        F.lit(0).cast("long").alias("words"),
    )
    return nodes.unionByName(roots)


def end_digests(members: DataFrame) -> DataFrame:
    """`a, b, ends_sha256`: SHA-256 of the ids of the conversations that end at a node, ascending, comma-joined.

    Ids are joined in blocks of id space; a node with several blocks is read in order by one task that keeps the
    state of the hash only.
    """
    ends = members.groupBy("conv").agg(F.max_by(F.struct("a", "b"), "depth").alias("node"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    blocks = ends.groupBy(
        F.col("node.a").alias("a"), F.col("node.b").alias("b"), F.floor(F.col("conv") / ID_BLOCK).alias("block")
    ).agg(ids.alias("ids"))
    blocks = written(blocks, "ends")
    counted = blocks.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("ids").alias("ids"))
    single = counted.where("n = 1").select("a", "b", F.sha2("ids", 256).alias("ends_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, state = None, sha256()
        for batch in batches:
            for *node, text in zip(*(c.to_pylist() for c in batch.columns)):
                if node == now:
                    state.update(b",")
                elif now is not None:
                    out.append((*now, state.hexdigest()))
                if node != now:
                    now, state = node, sha256()
                state.update(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["a", "b", "ends_sha256"])
                out = []
        if now is not None:
            last = [(*now, state.hexdigest())]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*last)], names=["a", "b", "ends_sha256"])

    several = blocks.join(counted.where("n > 1").select("a", "b"), ["a", "b"])
    streamed = several.repartition("a", "b").sortWithinPartitions("a", "b", "block").select("a", "b", "ids")
    return single.unionByName(streamed.mapInArrow(run, "a long, b long, ends_sha256 string"))


def _coin(conv: Column, depth: Column, turn: int, deepest: int) -> Column:
    """A bit per node: of a chain that is still whole every second node has it, whatever happened before."""
    if 1 << turn <= deepest:
        return F.shiftright(depth, turn).bitwiseAND(F.lit(1).cast("long"))
    return F.xxhash64(conv, depth, F.lit(turn)).bitwiseAND(F.lit(1).cast("long"))


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """`conv, depth, leaves, saved`: both summed over the subtree of every node of `nodes(conv, depth, pconv, pdepth,
    children, leaves, saved)`, whose root has depth 0 and no parent.

    Rounds alternate rake and compress. Rake: leaves go, their sums are final and go to the parent. Compress: of nodes
    with one child left, an independent set is spliced out; the child hangs on the node's parent with the node's sums
    on its link. Then the rounds are undone: a spliced node's total is what it held plus its child's total.
    """
    link = [F.lit(0).cast("long").alias("link_leaves"), F.lit(0).cast("long").alias("link_saved")]
    active = written(nodes.select("*", *link), "active")
    deepest = active.agg(F.max("depth")).first()[0]
    rounds: list[tuple[DataFrame, DataFrame | None]] = []
    own, parent = ["conv", "depth"], ["pconv", "pdepth"]
    for turn in range(10_000 if deepest is not None else 0):
        leaf = F.col("children") == 0
        gone = active.where(leaf).select(*own, "leaves", "saved")
        below = active.groupBy(*parent).agg(
            F.sum(F.when(leaf, F.col("leaves") + F.col("link_leaves")).otherwise(0)).alias("add_leaves"),
            F.sum(F.when(leaf, F.col("saved") + F.col("link_saved")).otherwise(0)).alias("add_saved"),
            F.sum(F.when(leaf, 0).otherwise(1)).alias("left"),
            F.min(F.when(~leaf, F.struct(*own))).alias("only"),
        )
        below = below.withColumnsRenamed({"pconv": "conv", "pdepth": "depth"})
        raked = active.where(~leaf).join(below, own)
        coin, next_coin = (_coin(F.col(c), F.col(d), turn, deepest) for c, d in (own, ("only.conv", "only.depth")))
        spliced = (F.col("depth") > 0) & (F.col("left") == 1) & (coin == 1) & (next_coin == 0)
        raked = written(
            raked.select(
                *own,
                *parent,
                (F.col("leaves") + F.col("add_leaves")).alias("leaves"),
                (F.col("saved") + F.col("add_saved")).alias("saved"),
                "link_leaves",
                "link_saved",
                F.col("left").alias("children"),
                "only",
                F.coalesce(spliced, F.lit(False)).alias("spliced"),
            ),
            "raked",
        )
        if raked.isEmpty():
            rounds.append((gone, None))
            break
        out = raked.where("spliced").select(
            F.col("only.conv").alias("conv"),
            F.col("only.depth").alias("depth"),
            *(F.col(c).alias(f"out_{c}") for c in (*own, *parent, "leaves", "saved", "link_leaves", "link_saved")),
        )
        met = written(raked.where("NOT spliced").drop("only", "spliced").join(out, own, "left"), "met")
        moved = F.col("out_conv").isNotNull()
        up = lambda c: F.when(moved, F.col(f"out_{c}")).otherwise(F.col(c)).alias(c)
        longer = lambda c: (
            F.col(f"link_{c}") + F.coalesce(F.col(f"out_{c}") + F.col(f"out_link_{c}"), F.lit(0))
        ).alias(f"link_{c}")
        active = met.select(*own, *map(up, parent), "leaves", "saved", longer("leaves"), longer("saved"), "children")
        held = met.where(moved).select(
            *own,
            "out_conv",
            "out_depth",
            (F.col("out_leaves") + F.col("link_leaves")).alias("out_leaves"),
            (F.col("out_saved") + F.col("link_saved")).alias("out_saved"),
        )
        rounds.append((gone, held))

    totals = nodes.select(*own, "leaves", "saved").limit(0)
    for gone, held in reversed(rounds):
        if held is not None:
            found = held.join(totals, own).select(
                F.col("out_conv").alias("conv"),
                F.col("out_depth").alias("depth"),
                (F.col("out_leaves") + F.col("leaves")).alias("leaves"),
                (F.col("out_saved") + F.col("saved")).alias("saved"),
            )
            totals = totals.unionByName(written(found, "totals"))
        totals = totals.unionByName(gone)
    return totals


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of `turns(conv, place, body, words)`; conversations without turns end at the root.

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree: words of the node's last turn, for every member but one), ends_sha256. An empty
    table gives no nodes. Sums beyond a long are an error.
    """
    members = written(memberships(turns, convs), "members")
    nodes = members.groupBy("a", "b").agg(
        F.min("conv").alias("conv"),
        F.max("depth").alias("depth"),
        F.max("pa").alias("pa"),
        F.max("pb").alias("pb"),
        F.max("words").alias("words"),
        F.count("*").alias("n_convs"),
    )
    nodes = written(nodes, "nodes")
    above = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("pconv"))
    children = nodes.groupBy("pa", "pb").agg(F.count("*").alias("children"))
    children = children.withColumnsRenamed({"pa": "a", "pb": "b"})
    nodes = nodes.join(above, ["pa", "pb"], "left").join(children, ["a", "b"], "left")
    nodes = written(nodes.na.fill(0, ["children"]).drop("pa", "pb"), "nodes")
    totals = subtree_totals(
        nodes.select(
            "conv",
            "depth",
            "pconv",
            (F.col("depth") - 1).alias("pdepth"),
            "children",
            F.when(F.col("children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        )
    )
    return (
        nodes.join(totals, ["conv", "depth"])
        .join(end_digests(members), ["a", "b"], "left")
        .select(
            F.col("conv").alias("conv_id"),
            "depth",
            F.col("pconv").alias("parent_conv_id"),
            "n_convs",
            F.col("children").alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
