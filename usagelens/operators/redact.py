"""Redaction of personal data with numbered, restorable placeholders.

A text goes through the patterns in order, each on the result of the one before.
Finding and replacing are two steps: the first lists what each text holds, then
values are numbered over the whole request in first-seen order, then texts that
hold something are rewritten. So the request may be a row with its messages or
many rows of a turns table, and the numbering is the same.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from usagelens.functions.pii import DEFAULT_PATTERNS, Pattern
from usagelens.schemas import MAX_BODY_BYTES
from usagelens.session import stored
from usagelens.sources.requests import gather_messages, oversize_turns

_STRINGS = "array<string>"
TURN_BLOCK = 4096


def _matches(text: Column, p: Pattern) -> Column:
    found = F.regexp_extract_all(text, F.lit(p.regex), F.lit(0))
    if p.valid is not None:
        found = F.filter(found, p.valid)
    if p.needs is None:
        return found
    return F.when(p.needs(text), found).otherwise(F.array().cast(_STRINGS))


def _rewrite(text: Column, p: Pattern, matches: Column, name) -> Column:
    """Gaps and matches of the text in turn, each valid match under its new name.

    ``matches`` are the valid ones; where a pattern has no further check they are
    all there are, and the text need not be searched for them again.
    """
    gaps = F.split(text, p.regex, -1)
    if p.valid is None:
        hits = matches
    else:
        hits = F.regexp_extract_all(text, F.lit(p.regex), F.lit(0))

    def piece(gap: Column, hit: Column) -> Column:
        new = name(hit) if p.valid is None else F.when(p.valid(hit), name(hit)).otherwise(hit)
        return F.concat(gap, F.coalesce(new, F.lit("")))

    return F.array_join(F.zip_with(gaps, hits, piece), "")


_ENTRIES = "array<struct<tag:string,value:string,name:string>>"
_VALUES = "array<struct<tag:string,value:string>>"
_RESULT = f"struct<texts:{_STRINGS},named:{_ENTRIES}>"


def _let(value: Column, body, kind: str) -> Column:
    """``body(value)``, of type ``kind``, with the value worked out once.

    The whole redaction is one expression of such steps. As a chain of columns it
    would be multiplied out whenever a filter is pushed through the projections.
    The type is stated because deriving it through the nested steps costs more
    than the work itself.
    """
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, v: body(v))


def _search(
    texts: Column, pats: Sequence[Pattern], then, kind: str, found: tuple = ()
) -> Column:
    """``then`` of the valid matches: per pattern, an array per text.

    Each pattern reads the texts with a stand-in where earlier patterns
    matched; the number in the stand-in plays no part in later matches.
    """
    p, rest = pats[0], pats[1:]

    def go_on(mine: Column) -> Column:
        if not rest:
            return then([*found, mine])
        stand_in = F.lit(f"[{p.tag}_1]")

        def masked(t: Column, vs: Column) -> Column:
            if p.valid is None:
                new = F.regexp_replace(t, F.lit(p.regex), stand_in)
            else:
                new = _rewrite(t, p, vs, lambda _: stand_in)
            return F.when(F.size(vs) > 0, new).otherwise(t)

        return _let(
            F.zip_with(texts, mine, masked),
            lambda w: _search(w, rest, then, kind, (*found, mine)),
            kind,
        )

    return _let(F.transform(texts, lambda t: _matches(t, p)), go_on, kind)


def _searchable(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.coalesce(t, F.lit("")))


def _tags(pats: Sequence[Pattern]) -> list[str]:
    return list(dict.fromkeys(p.tag for p in pats))


def _listed(found: list[Column], pats: Sequence[Pattern]) -> Column:
    """Entries {tag, value} of all texts: text by text, pattern by pattern."""
    each = [
        F.transform(
            found[i],
            lambda vs: F.transform(
                vs, lambda v: F.struct(F.lit(p.tag).alias("tag"), v.alias("value"))
            ),
        )
        for i, p in enumerate(pats)
    ]
    joined = each[0]
    for more in each[1:]:
        joined = F.zip_with(joined, more, lambda a, b: F.concat(a, b))
    return F.flatten(joined)


def _entry(tag: Column, value: Column, index: Column) -> Column:
    name = F.concat(tag, F.lit("_"), (index + 1).cast("string"))
    return F.struct(tag.alias("tag"), value.alias("value"), name.alias("name"))


def _in_one_go(
    texts: Column, pats: Sequence[Pattern], seen: tuple = ()
) -> Column:
    """Redact with the standard patterns, numbering each as it is found.

    No value can match two of the standard tags, so each tag counts alone and
    its numbers are known once its own matches are.
    """
    p, rest = pats[0], pats[1:]

    def go_on(found: Column) -> Column:
        def numbered(own: Column) -> Column:
            def rewritten(t: Column, vs: Column) -> Column:
                def name(v: Column) -> Column:
                    n = F.array_position(own, v).cast("string")
                    return F.concat(F.lit(f"[{p.tag}_"), n, F.lit("]"))

                return F.when(F.size(vs) > 0, _rewrite(t, p, vs, name)).otherwise(t)

            entries = F.transform(own, lambda v, n: _entry(F.lit(p.tag), v, n))
            new = F.when(F.size(own) > 0, F.zip_with(texts, found, rewritten)).otherwise(texts)
            done = (*seen, entries)
            if rest:
                return _let(new, lambda t: _in_one_go(t, rest, done), _RESULT)
            return F.struct(new.alias("texts"), F.concat(*done).alias("named"))

        return _let(F.array_distinct(F.flatten(found)), numbered, _RESULT)

    return _let(F.transform(texts, lambda t: _matches(t, p)), go_on, _RESULT)


def _numbered(found: list[Column], pats: Sequence[Pattern]) -> Column:
    """Entries {tag, value, name}, numbered per tag in first-seen order."""
    # With other patterns a value belongs to the tag that met it first.
    def named(seen: Column) -> Column:
        values = F.transform(seen, lambda s: s["value"])
        owned = F.transform(
            F.array_distinct(values),
            lambda v: F.get(seen, F.array_position(values, v).cast("int") - 1),
        )
        return _let(
            owned,
            lambda all_: F.concat(
                *[
                    F.transform(
                        F.filter(all_, lambda o: o["tag"] == t),
                        lambda o, n: _entry(o["tag"], o["value"], n),
                    )
                    for t in _tags(pats)
                ]
            ),
            _ENTRIES,
        )

    return _let(_listed(found, pats), named, _ENTRIES)


def _replaced(texts: Column, found: list[Column], names: Column, pats: Sequence[Pattern]) -> Column:
    """The texts that hold something, rewritten with the map value -> name."""
    for p, mine in zip(pats, found):

        def rewritten(t: Column, vs: Column) -> Column:
            new = _rewrite(
                t, p, vs, lambda v: F.concat(F.lit("["), F.try_element_at(names, v), F.lit("]"))
            )
            return F.when(F.size(vs) > 0, new).otherwise(t)

        texts = F.zip_with(texts, mine, rewritten)
    return texts


def redaction(texts: Column, pats: Sequence[Pattern] = DEFAULT_PATTERNS) -> Column:
    """Struct {texts, named} for an array of texts that form one request."""
    if all(p in DEFAULT_PATTERNS for p in pats):
        return _let(_searchable(texts), lambda t: _in_one_go(t, pats), _RESULT)

    def finish(found: list[Column]) -> Column:
        def with_names(named: Column) -> Column:
            names = F.map_from_entries(
                F.transform(named, lambda e: F.struct(e["value"], e["name"]))
            )
            return _let(
                names,
                lambda m: F.struct(
                    _replaced(texts, found, m, pats).alias("texts"), named.alias("named")
                ),
                _RESULT,
            )

        return _let(_numbered(found, pats), with_names, _RESULT)

    return _let(_searchable(texts), lambda t: _search(t, pats, finish, _RESULT), _RESULT)


def redact_texts(
    df: DataFrame, texts: str, pats: Sequence[Pattern] = DEFAULT_PATTERNS, enabled: bool = True
) -> DataFrame:
    """Redact an array of texts as one request.

    The array is replaced; ``redaction_map`` (placeholder -> value),
    ``pii_counts`` (tag -> unique values) and ``unique_tokens`` are added.
    """
    if not enabled or not pats:
        return (
            df.withColumn("redaction_map", _empty_map("string"))
            .withColumn("pii_counts", _empty_map("int"))
            .withColumn("unique_tokens", F.lit(0))
        )
    df = df.withColumn("_r", redaction(F.col(texts), pats))
    named = F.coalesce("_r.named", F.expr(f"cast(array() as {_ENTRIES})"))
    counts = [
        F.struct(
            F.lit(t).alias("k"),
            F.size(F.filter("_named", lambda e: e["tag"] == t)).alias("v"),
        )
        for t in _tags(pats)
    ]
    out = df.withColumn("_named", named)
    return (
        out.withColumn(texts, _nulls_kept(texts))
        .withColumn(
            "redaction_map",
            F.map_from_entries(F.transform("_named", lambda e: F.struct(e["name"], e["value"]))),
        )
        .withColumn(
            "pii_counts", F.map_from_entries(F.filter(F.array(*counts), lambda c: c["v"] > 0))
        )
        .withColumn("unique_tokens", F.size("_named"))
        .drop("_r", "_named")
    )


def _nulls_kept(texts: str) -> Column:
    return F.zip_with(texts, "_r.texts", lambda old, new: F.when(old.isNotNull(), new))


def _empty_map(kind: str) -> Column:
    return F.expr(f"map_from_entries(cast(array() as array<struct<k:string,v:{kind}>>))")


def redact_column(
    df: DataFrame, text: str, pats: Sequence[Pattern] = DEFAULT_PATTERNS, enabled: bool = True
) -> DataFrame:
    """Redact one text column; each row is a request of its own."""
    out = redact_texts(df.withColumn("_texts", F.array(text)), "_texts", pats, enabled)
    redacted = F.when(F.col(text).isNotNull(), F.get(F.col("_texts"), F.lit(0)))
    return out.withColumn(text, redacted).drop("_texts")


def redact_checked(
    df: DataFrame,
    text: str,
    key: str,
    extra: Pattern,
    check: Callable[[pd.Series], pd.Series],
    pats: Sequence[Pattern] = DEFAULT_PATTERNS,
) -> DataFrame:
    """``redact_column`` with an extra pattern whose matches any Python function checks.

    The function gets the distinct matches of all texts in Arrow batches, once
    each, and says which are valid; the verdicts are joined back to the rows by
    ``key``, which must be unique. The extra pattern comes after the others and
    needs a tag of its own.
    """
    if extra.tag in _tags(pats):
        raise ValueError(f"tag {extra.tag} is taken")
    first = stored(redact_column(df, text, pats), "redacted")
    held = F.array_distinct(_matches(F.col(text), extra))
    matches = first.select(key, F.explode(held).alias("_value"))

    @F.pandas_udf("boolean")
    def verdict(values: pd.Series) -> pd.Series:
        return check(values)

    # Written, so that the function sees each match once.
    fine = stored(matches.select("_value").distinct().withColumn("_ok", verdict("_value")), "verdicts").filter("_ok")
    # Holds no more than one row's own matches.
    valid = matches.join(fine.select("_value"), "_value").groupBy(key).agg(F.collect_list("_value").alias("_valid"))
    rows = first.join(valid, key, "left").withColumnsRenamed(
        {"redaction_map": "_map", "pii_counts": "_counts", "unique_tokens": "_unique"}
    )
    allowed = replace(extra, valid=lambda v: F.coalesce(F.array_contains(F.col("_valid"), v), F.lit(False)))
    out = redact_column(rows, text, [allowed])
    return (
        out.withColumn("redaction_map", F.map_concat("_map", "redaction_map"))
        .withColumn("pii_counts", F.map_concat("_counts", "pii_counts"))
        .withColumn("unique_tokens", F.col("_unique") + F.col("unique_tokens"))
        .drop("_map", "_counts", "_unique", "_valid")
    )


def redact_requests(
    df: DataFrame,
    messages: str = "messages",
    system: str = "system",
    pats: Sequence[Pattern] = DEFAULT_PATTERNS,
    enabled: bool = True,
) -> DataFrame:
    """Redact request rows: every message in order, then the system text."""
    contents = F.transform(messages, lambda m: m["content"])
    df = df.withColumn("_texts", F.concat(contents, F.array(F.col(system))))
    df = redact_texts(df, "_texts", pats, enabled)
    # Pairing, not indexing: a text looked up inside the lambda would be
    # worked out again for every message.
    shown = F.zip_with(
        messages,
        F.slice("_texts", F.lit(1), F.size(messages)),
        lambda m, t: F.struct(
            m["role"].alias("role"), F.when(m["content"].isNotNull(), t).alias("content")
        ),
    )
    last = F.when(F.col(system).isNotNull(), F.element_at("_texts", -1))
    return df.withColumn(messages, shown).withColumn(system, last).drop("_texts")


#: Numbers of the stand-ins of one text start here; seven digits, so that no later pattern reads more than a tag in them.
_FIRST_MARK = 9_000_001


def _marked(text: Column, pats: Sequence[Pattern]) -> Column:
    """Struct {text, found}: the text with every match under a stand-in of its own, and the matches in that order.

    Each pattern searches the text once, on the result of the one before; its
    k-th match becomes ``[TAG_n]`` with the next free number n. What a match took
    in of earlier stand-ins is shown as ``[TAG_1]``, whatever its number.
    """
    kind, tags = f"struct<text:string,found:{_VALUES}>", [re.escape(t) for t in _tags(pats)]

    def step(state: Column, pats: Sequence[Pattern]) -> Column:
        p, rest = pats[0], pats[1:]

        def go_on(hits: Column) -> Column:
            def known(both: Column) -> Column:
                gaps = F.split(state["text"], p.regex, -1)
                start = F.size(state["found"]) + _FIRST_MARK

                # Places of the valid matches among the valid ones: all of them, where there is no further check.
                def place(i: Column) -> Column:
                    if p.valid is None:
                        return i
                    return F.size(F.filter(F.slice(both["ok"], F.lit(1), i + 1), lambda o: o)) - 1

                def piece(gap: Column, i: Column) -> Column:
                    name = F.concat(F.lit(f"[{p.tag}_"), (start + place(i)).cast("string"), F.lit("]"))
                    hit = F.get(both["hits"], i)
                    if p.valid is not None:
                        name = F.when(F.get(both["ok"], i), name).otherwise(hit)
                    return F.concat(gap, F.when(i < F.size(both["hits"]), name).otherwise(F.lit("")))

                values = both["hits"] if p.valid is None else F.filter(both["hits"], lambda v, i: F.get(both["ok"], i))
                taken_in = F.lit(rf"\[({'|'.join(tags)})_9[0-9]{{6}}\]")
                plain = F.transform(
                    values,
                    lambda v: F.struct(
                        F.lit(p.tag).alias("tag"),
                        F.regexp_replace(v, taken_in, F.lit("[$1_1]")).alias("value"),
                    ),
                )
                new = F.struct(
                    F.array_join(F.transform(gaps, piece), "").alias("text"),
                    F.concat(state["found"], plain).alias("found"),
                )
                return F.when(F.size(both["hits"]) > 0, new).otherwise(state)

            ok = F.transform(hits, p.valid) if p.valid is not None else F.expr("cast(array() as array<boolean>)")
            pair = F.struct(hits.alias("hits"), ok.alias("ok"))
            done = _let(pair, known, kind)
            return _let(done, lambda st: step(st, rest), kind) if rest else done

        hits = F.regexp_extract_all(state["text"], F.lit(p.regex), F.lit(0))
        if p.needs is not None:
            hits = F.when(p.needs(state["text"]), hits).otherwise(F.array().cast(_STRINGS))
        return _let(hits, go_on, kind)

    first = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.expr(f"cast(array() as {_VALUES})").alias("found"))
    return _let(first, lambda st: step(st, pats), kind)


def redact_turns(
    turns: DataFrame,
    request: str = "conv_id",
    turn: str = "turn",
    text: str = "text",
    pats: Sequence[Pattern] = DEFAULT_PATTERNS,
) -> DataFrame:
    """Redact a table with one row per message, numbering over each request.

    Every text is searched once, which leaves it with stand-ins and a list of
    what they stand for; texts that hold something are written to the shared
    folder in that form. No request is gathered into one row or task: only the
    values are shuffled, they are numbered block by block of turns, and each
    turn's stand-ins then get the names of their values. Adds ``has_redactions``.
    """
    return _redact_turns(turns, request, turn, text, pats)[0]


def turn_values(turns, request, turn, text, pats=DEFAULT_PATTERNS) -> DataFrame:
    """One row per match: request, turn, place in the turn, tag, value."""
    return _values_of(_searched(turns, request, turn, text, pats).select(request, "_turn", "_m.found"), request)


def _searched(turns, request, turn, text, pats) -> DataFrame:
    """The turns with what a search leaves; as a generated row, which no filter above makes Spark work out again."""
    return turns.select(request, F.col(turn).alias("_turn"), F.explode(F.array(_marked(F.col(text), pats))).alias("_m"))


def _values_of(marked: DataFrame, request: str) -> DataFrame:
    each = F.posexplode("found").alias("_at", "_e")
    return marked.select(request, "_turn", each).select(request, "_turn", "_at", "_e.tag", "_e.value")


def _redact_turns(turns, request, turn, text, pats=DEFAULT_PATTERNS) -> tuple[DataFrame, DataFrame]:
    """The turns, and the number of unique values of each request that holds any."""
    marked = _searched(turns, request, turn, text, pats)
    marked = stored(
        marked.filter(F.size("_m.found") > 0).select(request, "_turn", "_m.text", "_m.found"), "marked"
    ).withColumnRenamed("text", "_text")
    found = _values_of(marked, request)
    named = number_values(found, request)
    per_turn = (
        found.join(named.select(request, "value", "name"), [request, "value"])
        .groupBy(request, "_turn")
        # Holds no more than one turn's own matches.
        .agg(F.array_sort(F.collect_list(F.struct("_at", "tag", "name"))).alias("_names"))
    )

    def put(t: Column, e: Column) -> Column:
        mark = F.concat(F.lit("["), e["tag"], F.lit("_"), (e["_at"] + _FIRST_MARK).cast("string"), F.lit("]"))
        return F.replace(t, mark, F.concat(F.lit("["), e["name"], F.lit("]")))

    new = marked.join(per_turn, [request, "_turn"]).select(
        request, "_turn", F.aggregate("_names", F.col("_text"), put).alias("_new")
    )
    out = turns.withColumn("_turn", F.col(turn)).join(new, [request, "_turn"], "left")
    out = out.withColumn("has_redactions", F.col("_new").isNotNull()).withColumn(text, F.coalesce("_new", text))
    counts = named.groupBy(request).agg(F.count("*").cast("int").alias("unique_tokens"))
    return out.select(*turns.columns, "has_redactions"), counts


def redact_messages(
    turns: DataFrame,
    request: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    pats: Sequence[Pattern] = DEFAULT_PATTERNS,
    max_bytes: int = MAX_BODY_BYTES,
) -> DataFrame:
    """Every message of every request, redacted: ``request, pos, role, text, unique_tokens, oversize``.

    Requests within the body limit are gathered and redacted as one row each;
    larger ones are worked on as rows of turns, and there ``pos`` is the turn's
    number.
    """
    rows = gather_messages(turns, request, turn, role, text, max_bytes).filter(~F.col("oversize"))
    small = redact_requests(rows.withColumn("system", F.lit(None).cast("string")), pats=pats)
    small = small.select(request, F.posexplode("messages").alias("pos", "m"), "unique_tokens").select(
        request, F.col("pos").cast("long").alias("pos"), F.col("m.role").alias("role"),
        F.col("m.content").alias("text"), "unique_tokens", F.lit(False).alias("oversize"),
    )
    big, counts = _redact_turns(oversize_turns(turns, request, role, text, max_bytes), request, turn, text, pats)
    big = big.join(counts, request, "left").select(
        request, F.col(turn).cast("long").alias("pos"), F.col(role).alias("role"), F.col(text).alias("text"),
        F.coalesce("unique_tokens", F.lit(0)).alias("unique_tokens"), F.lit(True).alias("oversize"),
    )
    return small.unionByName(big)


def number_values(found: DataFrame, request: str, block: int = TURN_BLOCK) -> DataFrame:
    """Number each request's distinct values per tag in first-seen order.

    Ranks are taken within blocks of turns and shifted by the sizes of the
    blocks before, so a very long request is ranked by many tasks.
    """
    first = found.groupBy(request, "value").agg(
        F.min(F.struct("_turn", "_at", "tag")).alias("_first")
    )
    first = first.select(
        request,
        "value",
        F.col("_first._turn").alias("_turn"),
        F.col("_first._at").alias("_at"),
        F.col("_first.tag").alias("tag"),
        F.floor(F.col("_first._turn") / F.lit(block)).alias("_block"),
    )
    sizes = first.groupBy(request, "tag", "_block").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(request, "tag").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shift = sizes.select(
        request, "tag", "_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift")
    )
    within = Window.partitionBy(request, "tag", "_block").orderBy("_turn", "_at")
    ranked = first.withColumn("_rank", F.row_number().over(within))
    return ranked.join(shift, [request, "tag", "_block"]).select(
        request,
        "tag",
        "value",
        (F.col("_rank") + F.col("_shift")).alias("n"),
        F.concat_ws("_", "tag", (F.col("_rank") + F.col("_shift")).cast("string")).alias("name"),
    )


def restored(text: Column, redaction_map: Column) -> Column:
    """Put the original values back for every bracketed placeholder."""
    return F.aggregate(
        F.map_entries(redaction_map),
        text,
        lambda t, e: F.replace(t, F.concat(F.lit("["), e["key"], F.lit("]")), e["value"]),
    )


def restore_responses(
    responses: DataFrame, redacted: DataFrame, request: str = "request_id", text: str = "response"
) -> DataFrame:
    """Restore each response with the map of the request it answers."""
    maps = redacted.select(request, "redaction_map").filter(F.size("redaction_map") > 0)
    back = F.when(
        F.col("redaction_map").isNotNull(), restored(F.col(text), F.col("redaction_map"))
    ).otherwise(F.col(text))
    return (
        responses.join(maps, request, "left").withColumn(text, back).select(*responses.columns)
    )


def map_header(redaction_map: Column) -> Column:
    """The map as base64 of JSON with sorted keys; empty when nothing was redacted."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(redaction_map)))
    text = F.to_json(ordered)
    # The header's JSON escapes characters that matter in HTML.
    for raw, escaped in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return F.when(F.size(redaction_map) > 0, F.translate(F.base64(F.encode(text, "UTF-8")), "\r\n", "")).otherwise(F.lit(""))


def redact_bodies(
    df: DataFrame,
    body: str = "body",
    pats: Sequence[Pattern] = DEFAULT_PATTERNS,
    enabled: bool = True,
    fail_closed: bool = False,
) -> DataFrame:
    """Redact JSON request bodies, keeping fields the layout does not know.

    A body that is not a JSON object passes untouched. A missing body is a
    ``body_read`` error: it passes when failing open and is blocked otherwise.
    """
    error = F.when(F.col(body).isNull(), F.lit("body_read"))
    if not enabled:
        error = F.lit(None).cast("string")
    df = df.withColumn("redaction_error", error).withColumn(
        "blocked", F.col("redaction_error").isNotNull() & F.lit(fail_closed)
    )
    whole = "try_variant_get(try_parse_json({b}), '$', 'map<string,variant>')".format(b=body)
    df = df.withColumn("_fields", F.expr(whole))
    df = df.withColumn(
        "_messages",
        F.expr(
            "transform(try_variant_get(try_element_at(_fields, 'messages'), '$', 'array<variant>'),"
            " m -> try_variant_get(m, '$', 'map<string,variant>'))"
        ),
    ).withColumn(
        "_raw_messages",
        F.expr("try_variant_get(try_element_at(_fields, 'messages'), '$', 'array<variant>')"),
    )
    df = df.withColumn(
        "_texts",
        F.expr(
            "concat(coalesce(transform(_messages, m -> if(schema_of_variant(try_element_at(m, 'content'))"
            " = 'STRING', try_variant_get(try_element_at(m, 'content'), '$', 'string'), null)),"
            " cast(array() as array<string>)),"
            " array(if(schema_of_variant(try_element_at(_fields, 'system')) = 'STRING',"
            " try_variant_get(try_element_at(_fields, 'system'), '$', 'string'), null)))"
        ),
    ).withColumn("_before", F.col("_texts"))
    df = redact_texts(df, "_texts", pats, enabled)
    parts = F.expr(
        "map_concat("
        " map_filter(_fields, (k, v) -> not (k <=> 'messages' and _messages is not null)"
        "   and not (k <=> 'system' and element_at(_before, -1) is not null)),"
        " if(_messages is null, map_from_entries(cast(array() as array<struct<k:string,v:variant>>)),"
        "  map('messages', cast(transform(_messages, (m, i) -> if(get(_before, i) is null,"
        "   get(_raw_messages, i),"
        "   to_variant_object(map_concat(map_filter(m, (k, v) -> k <> 'content'),"
        "    map('content', cast(get(_texts, i) as variant)))))) as variant))),"
        " if(element_at(_before, -1) is null, map_from_entries(cast(array() as array<struct<k:string,v:variant>>)),"
        "  map('system', cast(element_at(_texts, -1) as variant))))"
    )
    new_body = F.when(F.col("unique_tokens") > 0, F.to_json(F.to_variant_object(parts))).otherwise(
        F.col(body)
    )
    new_body = F.when(~F.col("blocked"), new_body)
    return df.withColumn(body, new_body).drop(
        "_fields", "_messages", "_raw_messages", "_texts", "_before"
    )


def pii_counts(redacted: DataFrame, team: str = "team_id") -> DataFrame:
    """Unique values redacted, by kind and team."""
    return (
        redacted.select(team, F.explode_outer("pii_counts").alias("pii_type", "n"))
        .filter(F.col("pii_type").isNotNull())
        .groupBy("pii_type", team)
        .agg(F.sum("n").cast("bigint").alias("redacted"))
    )


def requests_with_pii(redacted: DataFrame, team: str = "team_id") -> DataFrame:
    # Counted first and filtered after: a filter on the redacted rows would
    # redact them a second time.
    return (
        redacted.groupBy(team)
        .agg(
            F.count_if(F.col("unique_tokens") > 0).alias("requests"),
            F.sum("unique_tokens").cast("bigint").alias("unique_tokens"),
        )
        .filter(F.col("requests") > 0)
    )


def redaction_errors(redacted: DataFrame) -> DataFrame:
    return (
        redacted.filter(F.col("redaction_error").isNotNull())
        .groupBy(F.col("redaction_error").alias("cause"))
        .agg(F.count("*").alias("errors"))
    )
