"""Near-duplicate lines by a segment-partition edit join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.bloom import build, inside
from usagelens.llm.common import free_name, row_key, written
from usagelens.llm.components import components

#: Lines within so many edits are the same; shorter lines (code points) are left alone.
EDITS, LEAST_CHARS = 1, 20
#: Lines of one segment bucket that are paired; larger buckets are cut by single-character variants.
BUCKET = 100
#: Bits at most of the filter that lines pass before their texts are fetched.
FILTER_BITS = 1 << 25


def _segment(length: Column, number: int, edits: int) -> tuple[Column, Column]:
    """Start (from 0) and size of a segment: edits + 1 even ones, the longer at the end."""
    parts = edits + 1
    base = F.floor(length / parts).cast("int")
    long_ones = length % parts
    start = base * number + F.greatest(F.lit(0), F.lit(number - parts) + long_ones)
    return start, base + (F.lit(number) >= F.lit(parts) - long_ones).cast("int")


def signatures(line: Column, length: Column, edits: int) -> list[tuple[str, Column]]:
    """(role, hash) of a line: its own segments, and the substrings that may equal a segment of a line no longer.

    For a line shorter by `less`, and its segment `number`, a substring can equal it only at the shifts that leave
    enough edits on both sides.
    """
    out = []
    for less in range(edits + 1):
        other = length - less
        for number in range(edits + 1):
            start, size = _segment(other, number, edits)
            for shift in range(max(-number, less - (edits - number)), min(number, less + edits - number) + 1):
                role = "own" if not less and not shift else "probe"
                piece = F.substring(line, start + shift + 1, size)
                out.append((role, F.xxhash64(F.lit(number), other, piece)))
    return out


def _let(value: Column, then) -> Column:
    """`then(value)`, with the value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _common(a: Column, b: Column, most: Column) -> Column:
    """Length of the common beginning of two strings, `most` at most: steps of falling powers of two."""
    steps = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))

    def longer(have: Column, step: Column) -> Column:
        alike = F.substring(a, have + 1, step) == F.substring(b, have + 1, step)
        return F.when((step <= most - have) & alike, have + step).otherwise(have)

    return F.aggregate(steps, F.lit(0), longer)


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are within `edits`, by a banded bit-parallel edit distance.

    What both begin and end with is cut off first. One word of 2 * edits + 1 bits then holds the vertical differences
    of the band around the diagonal; every character of the shorter string moves the band on by one row. The score
    follows the diagonal that ends in the last cell, where it never falls: once above `edits` it is left as it is.
    """
    long_first = F.char_length(a) >= F.char_length(b)
    both = F.struct(
        F.when(long_first, a).otherwise(b).alias("longer"), F.when(long_first, b).otherwise(a).alias("shorter")
    )

    def measured(p: Column) -> Column:
        n = F.char_length(p["shorter"])
        begin = _common(p["longer"], p["shorter"], n)
        return _let(
            F.struct(
                p["longer"].alias("longer"),
                p["shorter"].alias("shorter"),
                F.char_length(p["longer"]).alias("m"),
                n.alias("n"),
                begin.alias("begin"),
            ),
            trimmed,
        )

    def trimmed(p: Column) -> Column:
        end = _common(F.reverse(p["longer"]), F.reverse(p["shorter"]), p["n"] - p["begin"])
        cut = F.struct(*(p[c].alias(c) for c in ("longer", "shorter", "m", "n", "begin")), end.alias("end"))
        return _let(cut, compared)

    def compared(p: Column) -> Column:
        m, n = p["m"] - p["begin"] - p["end"], p["n"] - p["begin"] - p["end"]
        characters = F.struct(
            F.split(F.substring(p["longer"], p["begin"] + 1, m), "").alias("longer"),
            F.split(F.substring(p["shorter"], p["begin"] + 1, n), "").alias("shorter"),
            m.alias("m"),
            n.alias("n"),
        )
        near = F.when(n == 0, m <= edits).otherwise(_let(characters, lambda c: _band(c, edits) <= edits))
        return F.when(m - n > edits, F.lit(False)).otherwise(near)

    return _let(both, measured)


def _band(p: Column, edits: int) -> Column:
    """Edit distance of `p.longer` and `p.shorter` (characters, `m` and `n` of them), exact up to `edits`."""
    width = 2 * edits + 1
    full = (1 << width) - 1

    def clipped(x: Column) -> Column:
        return x.bitwiseAND(F.lit(full))

    def step(s: Column, j: Column) -> Column:
        equal = [
            F.coalesce((F.get(p["longer"], j - 1 - edits + bit) == F.get(p["shorter"], j - 1)).cast("int"), F.lit(0))
            * (1 << bit)
            for bit in range(width)
        ]

        def column(pm: Column) -> Column:
            carried = (pm.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])
            return _let(clipped(carried.bitwiseOR(pm).bitwiseOR(s["vn"])), moved)

        def moved(d0: Column) -> Column:
            hp = s["vn"].bitwiseOR(clipped(F.bitwise_not(d0.bitwiseOR(s["vp"]))))
            hn = d0.bitwiseAND(s["vp"])
            below = F.shiftright(d0, 1)
            met = F.call_function("shiftright", d0, F.lit(edits) + p["m"] - p["n"]).bitwiseAND(F.lit(1))
            return F.struct(
                hn.bitwiseOR(clipped(F.bitwise_not(below.bitwiseOR(hp)))).alias("vp"),
                hp.bitwiseAND(below).alias("vn"),
                (s["score"] + 1 - met).alias("score"),
            )

        return F.when(s["score"] > edits, s).otherwise(_let(reduce(lambda x, y: x + y, equal), column))

    first = F.struct(
        F.lit(full & ~((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), (p["m"] - p["n"]).alias("score")
    )
    return F.aggregate(F.sequence(F.lit(1), p["n"]), first, step)["score"]


def _lines(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """`key, id, at, line, length` of the lines long enough."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return (
        docs.select(
            row_key(docs[id_col], docs[text_col]).alias("key"),
            docs[id_col].alias("id"),
            F.posexplode(F.split(text, "\n", -1)).alias("at", "line"),
        )
        .withColumn("line", F.trim("line"))
        .withColumn("length", F.char_length("line"))
        .where(F.col("length") >= least)
    )


def _node(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _single_character_variants(hot: DataFrame) -> DataFrame:
    """Candidate links among the lines of large buckets: a star for each shared variant, so their number is linear.

    Lines of equal length that agree without the character at one place differ in that place alone; a line that
    equals another without one character differs by that character.
    """
    cut = hot.select(
        "node", "line", "length", F.explode(F.sequence(F.lit(1), F.col("length"))).alias("at")
    ).select(
        "node",
        "at",
        F.col("length").alias("length"),
        F.xxhash64(F.concat(F.expr("substring(line, 1, at - 1)"), F.expr("substring(line, at + 1)"))).alias("rest"),
    )
    least = cut.groupBy("length", "at", "rest").agg(F.min("node").alias("b"))
    replaced = cut.join(least, ["length", "at", "rest"]).where("node <> b").select(F.col("node").alias("a"), "b")
    whole = hot.select(
        F.col("node").alias("b"), (F.col("length") + 1).alias("length"), F.xxhash64("line").alias("rest")
    )
    removed = cut.join(whole, ["length", "rest"]).select(F.col("node").alias("a"), "b")
    return replaced.unionByName(removed)


def line_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    edits: int = EDITS,
    least: int = LEAST_CHARS,
    bucket: int = BUCKET,
) -> tuple[DataFrame, DataFrame]:
    """The lines as `key, id, at, node` and the classes as `node, root`, for nodes linked to another one."""
    if edits < 1 or least <= 2 * edits:
        raise ValueError("lines must be longer than twice the edits")
    if edits > 1 and bucket is not None:
        raise ValueError("large buckets are cut for one edit only; set bucket to None to pair them whole")
    lines = _lines(docs, id_col, text_col, least)
    named = signatures(F.col("line"), F.col("length"), edits)
    names = [f"s{i}" for i in range(len(named))]
    seen = written(
        lines.select("key", "id", "at", _node(F.col("line")).alias("node"), *(s.alias(n) for n, (_, s) in zip(names, named))),
        "lines",
    )
    distinct = seen.groupBy("node").agg(*(F.first(n).alias(n) for n in names))
    marks = distinct.select(
        "node",
        F.explode(
            F.array(*(F.struct(F.lit(role == "own").alias("own"), F.col(n).alias("mark")) for n, (role, _) in zip(names, named)))
        ).alias("m"),
    ).select("node", "m.own", "m.mark")
    buckets = (
        marks.groupBy("mark")
        .agg(F.count("*").alias("members"), F.sum(F.col("own").cast("int")).alias("owners"))
        .where("members > 1 AND owners > 0")
    )
    members = written(marks.join(buckets, "mark").drop("owners"), "segments")
    paired = members if bucket is None else members.where(F.col("members") <= bucket)
    own = paired.where("own").select("mark", F.col("node").alias("b"))
    pairs = (
        paired.select("mark", F.col("node").alias("a"), "own")
        .join(own, "mark")
        .where("a <> b AND (NOT own OR a < b)")
        .select("a", "b")
    )
    wanted = members.select("node").distinct()
    # A filter of bounded size lets few other lines through to the join that decides.
    bits = min(FILTER_BITS, max(64, 64 * (wanted.count() * 10 // 64)))
    likely = build(wanted.select(F.col("node").alias("key"), F.lit(0).alias("slice")), 0, 1, 4, bits)
    texts = written(
        lines.select(_node(F.col("line")).alias("node"), "line", "length")
        .where(inside(F.col("node"), likely))
        .dropDuplicates(["node"])
        .join(wanted, "node", "left_semi"),
        "texts",
    )
    if bucket is not None:
        hot = members.where(F.col("members") > bucket).select("node").distinct()
        pairs = pairs.unionByName(_single_character_variants(texts.join(hot, "node")))
    sides = (
        pairs.distinct()
        .join(texts.select(F.col("node").alias("a"), F.col("line").alias("line_a")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("line").alias("line_b")), "b")
    )
    links = sides.where(within(F.col("line_a"), F.col("line_b"), edits)).select("a", "b")
    return seen.select("key", "id", "at", "node"), components(links)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """`key, removed`: for every row (by its key) that loses lines, the numbers of these lines, from 0.

    Lines (cut at line feeds, outer spaces aside) of at least LEAST_CHARS code points link when their edit distance is
    at most EDITS; of each connected class the first line stays, by document id, then line number (rows without id
    last). Rows that are repeats of each other share a key and count as one.
    """
    seen, classes = line_classes(docs, id_col, text_col, **settings)
    placed = seen.join(classes, "node", "left").select(
        "key", "at", F.coalesce("root", "node").alias("root"), F.struct(F.col("id").isNull(), "id", "key", "at").alias("place")
    )
    first = placed.groupBy("root").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Written, so that the join reads its own exchange of the lines: adaptive execution can split a very common line.
    first = written(first, "first")
    return (
        placed.join(first, "root").where("place <> first").groupBy("key").agg(F.array_sort(F.collect_set("at")).alias("removed"))
    )


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The id, `n_lines`, `n_removed` and `removed` (line numbers) of every row, rows that lose nothing included.

    A null text counts as empty: one empty line, which is too short to be judged. Repeated rows get equal results, a
    null id stays null, an empty table gives no rows, other columns are not read.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(
        docs[id_col].alias("id"),
        row_key(docs[id_col], docs[text_col]).alias("key"),
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n_lines"),
    )
    return rows.join(repeated_lines(docs, id_col, text_col, **settings), "key", "left").select(
        F.col("id").alias(id_col),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows without their repeated lines, with the columns of the input (`n_chars`, if there, follows the text).

    A row that has no word left goes; a row that lost nothing stays as it is, empty and null texts too.
    """
    key, cut = free_name(docs, "row_key"), free_name(docs, "removed")
    marked = docs.withColumn(key, row_key(docs[id_col], docs[text_col]))
    removed = repeated_lines(docs, id_col, text_col, **settings).select(
        F.col("key").alias(key), F.col("removed").alias(cut)
    )
    lines = F.split(text_col, "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(cut))
    kept = F.element_at(
        F.transform(F.array(lines), lambda all_: F.array_join(F.transform(places, lambda i: F.get(all_, i)), "\n")), 1
    )
    out = marked.join(removed, key, "left").withColumn(
        text_col, F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(kept)
    )
    out = out.where(F.col(cut).isNull() | (F.trim(F.regexp_replace(text_col, r"\s", "")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.char_length(text_col)))
    return out.select(*docs.columns)
