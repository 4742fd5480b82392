"""URL filter: host and path rules, then exact list membership by a cascade of Bloom filters."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.bloom import Level, build, inside
from usagelens.llm.common import LOWER, UPPER, written

#: (host, path, verdict); a rule fits its host and all subdomains.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: Bits of one level of one slice's cascade at most; a larger list is cut into more slices of the key space.
SLICE_BITS = 1 << 25
#: False positive rate of the levels after the first: each level leaves a sixteenth of the keys to the next.
LATER_RATE = 1 / 16


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; both null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for name, start, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


@dataclass(frozen=True)
class Cascade:
    slices: int
    levels: tuple[Level, ...]


def _slice_of(key: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slices).cast("long")).cast("int")


def cascade(universe: DataFrame, slice_bits: int = SLICE_BITS, most_levels: int = 64) -> Cascade:
    """Filters that tell listed keys from all others among `universe(key, listed)`, which must hold every key asked.

    Level 1 encodes the listed keys, level 2 the other keys that level 1 takes for listed, level 3 the listed keys
    that level 2 takes for those, and so on until a level errs on no key. The key space is cut into slices by hash so
    that a filter of a slice never exceeds `slice_bits`, whatever the length of the list.
    """
    counts = universe.groupBy("listed").count().collect()  # two rows
    n = {r["listed"]: r["count"] for r in counts}
    listed, others = n.get(True, 0), n.get(False, 0)
    if not listed:
        return Cascade(1, ())
    first_rate = min(0.5, max(1e-9, math.sqrt(0.5) * listed / max(others, 1)))
    # A quarter is left for slices that get more keys than others.
    slices = max(1, math.ceil(1.25 * listed * math.log2(1 / first_rate) / math.log(2) / slice_bits))
    keys = written(universe.withColumn("slice", _slice_of(F.col("key"), slices)), "keys")
    now, other = keys.where("listed").select("key", "slice"), keys.where("NOT listed").select("key", "slice")
    levels: list[Level] = []
    for number in range(1, most_levels + 1):
        largest = now.groupBy("slice").count().agg(F.max("count")).first()[0]
        if not largest:
            return Cascade(slices, tuple(levels))
        hashes = max(1, round(math.log2(1 / (first_rate if number == 1 else LATER_RATE))))
        bits = 64 * math.ceil(largest * hashes / math.log(2) / 64)
        levels.append(build(now, number, slices, hashes, bits))
        wrong = [
            other.where(F.col("slice") == s).where(inside(F.col("key"), levels[-1], s)) for s in range(slices)
        ]
        now, other = written(reduce(DataFrame.unionByName, wrong), "passed"), now
    raise RuntimeError("the cascade does not end")


def listed_in(rows: DataFrame, found: Cascade, out: str = "listed") -> DataFrame:
    """Adds whether each row's `key` is listed: no join; rows of a slice meet that slice's filters as scalars."""
    if not found.levels:
        return rows.withColumn(out, F.lit(False))
    sliced = written(rows.withColumn("slice", _slice_of(F.col("key"), found.slices)), "urls", by="slice")
    answers = []
    for s in range(found.slices):
        answer = F.lit(len(found.levels) % 2 == 1)
        for level in reversed(found.levels):
            answer = F.when(inside(F.col("key"), level, s), answer).otherwise(F.lit(level.number % 2 == 0))
        answers.append(sliced.where(F.col("slice") == s).withColumn(out, answer))
    return reduce(DataFrame.unionByName, answers).drop("slice")


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules=RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    slice_bits: int = SLICE_BITS,
) -> DataFrame:
    """`page_id, host, path, rule, verdict, listed` of every page; `listed(key)` holds host + path strings to block.

    The longest rule that fits decides (null if none fits); else a listed key is blocked and any other allowed. A
    null url, or one without `://`, has an empty host and path, and the empty key is never listed. Null keys in the
    list are ignored, repeated ones count once. Repeated pages get equal rows, a null id stays null, an empty table
    gives no rows. Other columns are not read.
    """
    host, path = parts(F.col("url"))
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url")).select(
        "id", host.alias("host"), path.alias("path"), F.concat(host, path).alias("key")
    )
    marked = listed.select(F.col("key"), F.lit(True).alias("listed")).where("key <> ''")
    universe = (
        rows.select("key", F.lit(False).alias("listed")).union(marked).groupBy("key").agg(F.max("listed").alias("listed"))
    )
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return listed_in(rows, cascade(universe, slice_bits)).select(
        F.col("id").alias(id_col),
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, by_list).alias("verdict"),
        "listed",
    )


def campaign_keys(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """A list to block: host + path of pages met with a campaign tag (`utm_source`) in the query."""
    host, path = parts(F.col(url_col))
    tagged = pages.where(F.col(url_col).rlike(r"^[^#]*\?[^#]*\butm_source="))
    return tagged.select(F.concat(host, path).alias("key")).distinct()
