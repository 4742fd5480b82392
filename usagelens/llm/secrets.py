"""Secrets in texts: candidates by a trigram index, verified by the rules' regexes."""

from __future__ import annotations

import math
from functools import reduce
from itertools import product
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.bloom import Level, build, inside
from usagelens.llm.common import written

#: kind: (regex, group that is measured, characters it needs). The first three are fixed values.
RULES = {
    "assign": (
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "private_key": (r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", 0, 1),
    "hosted_token": (r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    "signed_token": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
}
BASE = ("assign", "access", "hex")
#: Alternatives of one regex part that are spelt out before the part counts as unknown.
_SPELT = 64
#: Trigrams of one alternative that a query names.
_NAMED = 4
#: Bits at most of the filter that holds a rule's candidates.
FILTER_BITS = 1 << 27


def _grams(words: set[str]) -> frozenset | None:
    """One alternative per word, the trigrams it must hold; None when a word is too short to need any."""
    if any(len(w) < 3 for w in words):
        return None
    # Some, evenly spaced, are enough: each is mandatory by itself.
    return frozenset(
        frozenset(w[i : i + 3] for i in range(0, len(w) - 2, max(1, math.ceil((len(w) - 2) / _NAMED)))) for w in words
    )


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Trigrams (lower case) that every match must hold: all of the returned sets' alternatives, as OR of ANDs.

    Each entry of the result is one alternative; a text is a candidate if it holds all trigrams of some alternative.
    An empty list means that the regex has no mandatory trigram.
    """
    queries: list[frozenset] = []

    def spelt(node) -> set[str] | None:
        kind, value = node
        if kind is op.LITERAL:
            return {chr(value).lower()}
        if kind is op.IN and all(k is op.LITERAL for k, _ in value) and len(value) <= 8:
            return {chr(v).lower() for _, v in value}
        if kind is op.SUBPATTERN:
            return sequence(value[-1])
        if kind is op.BRANCH:
            found = [sequence(x) for x in value[1]]
            return None if any(f is None for f in found) else set().union(*found)
        if kind is op.MAX_REPEAT and value[1] <= 2:
            inner = sequence(value[2])
            if inner is not None:
                return {"".join(p) for n in range(value[0], value[1] + 1) for p in product(inner, repeat=n)}
        return None

    def sequence(nodes) -> set[str] | None:
        """All words of a part if it has few; else None, after its known stretches were noted as mandatory."""
        words, whole = {""}, True
        for node in nodes:
            found = spelt(node)
            if found is not None and len(words) * len(found) <= _SPELT:
                words = {a + b for a, b in product(words, found)}
                continue
            note(words)
            words, whole = (found if found is not None else {""}), False
        if not whole:
            note(words)
            return None
        return words

    def note(words: set[str]) -> None:
        grams = _grams(words)
        if grams:
            queries.append(grams)

    known = sequence(_parser.parse(regex))
    if known is not None:
        note(known)
    # The most selective stretch: fewest alternatives, then most trigrams.
    best = min(queries, key=lambda q: (len(q), -min(map(len, q))), default=None)
    return sorted(best, key=sorted) if best else []


def _trigrams(queries: dict[str, list[frozenset]]) -> list[str]:
    return sorted({g for q in queries.values() for alternative in q for g in alternative})


def trigram_index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings `gram, id`: each of the trigrams with the ids of the texts that hold it, in any case."""
    lowered = F.lower(F.coalesce("text", F.lit("")))
    held = [F.when(F.contains(F.col("lowered"), F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]
    return (
        docs.select("id", lowered.alias("lowered"))
        .select("id", F.explode(F.array_compact(F.array(*held))).alias("gram"))
        .distinct()
    )


def candidates(postings: DataFrame, queries: dict[str, list[frozenset]]) -> DataFrame:
    """`id` and a flag per kind: the postings of each alternative intersected, the alternatives united."""
    grams = _trigrams(queries)
    number = {g: i for i, g in enumerate(grams)}
    held = postings.groupBy("id").agg(
        F.bit_or(F.call_function("shiftleft", F.expr("1L"), F.col("gram"))).alias("mask")
    )
    flags = []
    for kind, query in queries.items():
        masks = [sum(1 << number[g] for g in alternative) for alternative in query]
        flags.append(
            reduce(lambda a, b: a | b, [F.col("mask").bitwiseAND(F.lit(m)) == m for m in masks]).alias(kind)
        )
    return held.select("id", *flags)


def _key(id_: Column) -> Column:
    return F.coalesce(id_.cast("string"), F.lit("-"))


def _filters(found: DataFrame, kinds: list[str]) -> dict[str, Level]:
    """For each rule a Bloom filter of its candidates' ids, of bounded size, so no text is moved to meet them.

    It lets every candidate through, and a few texts more, in which the regex finds nothing.
    """
    counts = found.agg(*(F.count_if(F.col(k)).alias(k) for k in kinds)).first()
    out = {}
    for number, kind in enumerate(kinds):
        bits = min(FILTER_BITS, max(64, 64 * (counts[kind] * 10 // 64)))
        keys = found.where(kind).select(_key(F.col("id")).alias("key"), F.lit(0).alias("slice"))
        out[kind] = build(keys, number, 1, 4, bits)
    return out


def _spans(text: Column, regex: str, group: int, least: int, kind: str, order: int) -> Column:
    """Leftmost matches that do not overlap, as structs (start, order, end, kind) in code points; short ones drop.

    The text between matches and the matches themselves are cut out by the same regex; their lengths add up to the
    places.
    """
    whole = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    sizes = F.transform(whole, lambda m: F.char_length(m))
    measured = sizes if not group else F.transform(
        F.regexp_extract_all(text, F.lit(regex), F.lit(group)), lambda m: F.char_length(m)
    )
    gaps = F.transform(F.split(text, regex, -1), lambda g: F.char_length(g))
    rows = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), measured.alias("measured"))
    # A text has one gap more than matches: the last row has no size.
    state = F.aggregate(
        F.filter(rows, lambda r: r["size"].isNotNull()),
        F.struct(
            F.lit(0).alias("at"),
            F.expr("CAST(array() AS array<struct<start:int,`order`:int,`end`:int,kind:string>>)").alias("found"),
        ),
        lambda s, r: F.struct(
            (s["at"] + r["gap"] + r["size"]).alias("at"),
            F.when(
                r["measured"] >= least,
                F.concat(
                    s["found"],
                    F.array(
                        F.struct(
                            (s["at"] + r["gap"]).alias("start"),
                            F.lit(order).alias("order"),
                            (s["at"] + r["gap"] + r["size"]).alias("end"),
                            F.lit(kind).alias("kind"),
                        )
                    ),
                ),
            )
            .otherwise(s["found"])
            .alias("found"),
        ),
    )
    return state["found"]


def _spelled(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=None) -> DataFrame:
    """The id, `n_assign`, `n_access`, `n_hex`, `base_sha256` and `spans` of every row.

    Every rule's regex is turned into a Boolean query over trigrams. An inverted index holds, for the trigrams that
    the queries name, the texts they occur in; postings are intersected, and a rule's regex runs over its candidates
    only. A rule without a mandatory trigram (such as `hex`) runs over all texts. The index is read by id, so texts
    that share an id are candidates together; the regex decides each alone.

    A null text counts as empty; repeated rows get equal results; a null id stays null; an empty table gives no rows;
    other columns are not read. Spans are in code points, by start, then kind in the order of the rules.
    """
    rules = rules or RULES
    queries = {k: q for k, (regex, _, _) in rules.items() if (q := trigram_query(regex))}
    if len(_trigrams(queries)) > 62:
        raise ValueError("an index has at most 62 trigrams; split the rules")
    plain = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    found = written(candidates(trigram_index(plain, _trigrams(queries)), queries), "candidates")
    asked_of = _filters(found, list(queries))
    rows = plain.withColumn("key", _key(F.col("id")))
    none = F.expr("CAST(array() AS array<struct<start:int,`order`:int,`end`:int,kind:string>>)")
    for order, (kind, (regex, group, least)) in enumerate(rules.items()):
        # Runs of one class are maximal, so those long enough can be asked for at once.
        asked = f"[0-9a-f]{{{least},}}" if regex == "[0-9a-f]+" else regex
        spans = _spans(F.col("text"), asked, group, least, kind, order)
        if kind in queries:
            spans = F.when(inside(F.col("key"), asked_of[kind]), spans).otherwise(none)
        else:
            spans = F.when(F.col("text").rlike(asked), spans).otherwise(none)
        rows = rows.withColumn(f"spans_{kind}", spans)
    base = F.array_sort(F.concat(*(F.col(f"spans_{k}") for k in BASE if k in rules)))
    every = F.array_sort(F.concat(*(F.col(f"spans_{k}") for k in rules)))
    return rows.select(
        F.col("id").alias(id_col),
        *(F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in BASE if k in rules),
        F.sha2(_spelled(base), 256).alias("base_sha256"),
        _spelled(every).alias("spans"),
    )
