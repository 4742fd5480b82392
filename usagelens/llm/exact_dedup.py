"""Exact duplicates by 128-bit content hash, with the bytes compared inside each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import ascii_lower, written


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, the row that stays of its equal texts, their number, whether it stays itself.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest id stays, so ids must be stable. Rows are grouped by the MD5 of the text together with the text itself,
    pre-aggregated on the map side, so the bytes decide and a group of any size is one row per task before the
    shuffle. A row finds its group by MD5 and SHA-256; should two different texts agree in both, the job fails
    rather than merge them.

    Nulls: a row without id never stays while its group has one with an id; among rows without id one stays, its
    `keep_id` null. Repeated rows: exactly one of them stays. An empty table gives no rows. Other columns of the
    input are not read, so their names cannot clash.
    """
    text = ascii_lower(F.coalesce(docs[text_col], F.lit("")))
    rows = written(
        docs.select(docs[id_col].alias("id"), text.alias("body")).select(
            "id",
            F.monotonically_increasing_id().alias("row"),
            F.unhex(F.md5("body")).alias("md5"),
            F.unhex(F.sha2("body", 256)).alias("sha"),
            "body",
        ),
        "exact",
    )
    texts = rows.groupBy("md5", "sha", "body").agg(
        F.count("*").alias("n"),
        F.max("id").alias("keep_id"),
        F.coalesce(F.max_by("row", "id"), F.max("row")).alias("keep_row"),
    )
    groups = (
        texts.groupBy("md5", "sha")
        .agg(
            F.count("*").alias("texts"),
            F.max("n").alias("group_size"),
            F.max("keep_id").alias("keep_id"),
            F.max("keep_row").alias("keep_row"),
        )
        .withColumn(
            "group_size",
            F.when(F.col("texts") == 1, F.col("group_size")).otherwise(
                F.raise_error(F.lit("different texts share MD5 and SHA-256")).cast("long")
            ),
        )
    )
    # Written, so that the join reads its own exchange of the rows: adaptive execution can split a large group.
    groups = written(groups.drop("texts"), "groups")
    return (
        rows.drop("body")
        .join(groups, ["md5", "sha"])
        .select(
            F.col("id").alias(id_col),
            "keep_id",
            "group_size",
            (F.col("row") == F.col("keep_row")).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )
