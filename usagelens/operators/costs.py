"""Cost reports over the usage log, for all teams at once or one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from usagelens.functions.pricing import projected_month

_GROUPS = {"model": "model_used", "feature": "feature_tag", "day": "day"}


def _day(usage: DataFrame) -> DataFrame:
    return usage.withColumn("day", F.date_trunc("day", "created_at"))


def total(usage: DataFrame) -> DataFrame:
    """One row; zero on empty input."""
    return usage.agg(F.coalesce(F.sum("cost_usd"), F.lit(0)).alias("cost_usd"))


def savings(usage: DataFrame) -> DataFrame:
    hit_cost = F.sum(F.when(F.col("cache_hit"), F.col("cost_usd")))
    return usage.agg(F.coalesce(hit_cost, F.lit(0)).alias("savings_usd"))


def by(usage: DataFrame, group: str) -> DataFrame:
    """Cost per team and model, feature or day."""
    column = _GROUPS[group]
    rows = _day(usage) if group == "day" else usage
    return rows.groupBy("team_id", F.col(column).alias(group)).agg(
        F.sum("cost_usd").alias("cost_usd")
    )


def breakdown(usage: DataFrame, group: str = "model") -> DataFrame:
    """Label, cost, requests and average cost; days newest first, others by cost.

    An unknown grouping gives no rows.
    """
    known = group in _GROUPS
    column = _GROUPS.get(group, "model_used")
    rows = _day(usage) if group == "day" else usage
    label = F.date_format("day", "yyyy-MM-dd") if group == "day" else F.col(column)
    out = rows.filter(F.lit(known)).groupBy("team_id", label.alias("label")).agg(
        F.sum("cost_usd").alias("cost_usd"),
        F.count("*").alias("request_count"),
        F.avg("cost_usd").alias("avg_cost_per_request"),
    )
    order = F.desc("label") if group == "day" else F.desc("cost_usd")
    return out.orderBy("team_id", order, "label")


def summary(usage: DataFrame, days: int) -> DataFrame:
    """Total, per model, per feature and per day in one reading of the log.

    The log is first reduced to one row per team, model, feature and day; the
    four sections are grouping sets over that small table. Totals include what
    cache hits would have cost; ``spent_usd`` leaves it out.
    """
    base = _day(usage).groupBy("team_id", "model_used", "feature_tag", "day").agg(
        F.sum("cost_usd").alias("cost"),
        F.sum(F.when(F.col("cache_hit"), F.col("cost_usd")).otherwise(F.lit(0))).alias("saved"),
    )
    keys = ["model_used", "feature_tag", "day"]
    sets = base.groupingSets(
        [
            [F.col("team_id")],
            [F.col("team_id"), F.col("model_used")],
            [F.col("team_id"), F.col("feature_tag")],
            [F.col("team_id"), F.col("day")],
        ],
        "team_id",
        *keys,
    ).agg(
        # Stated types: at full width a difference would lose its last digit.
        F.sum("cost").cast("decimal(28,8)").alias("cost_usd"),
        F.sum("saved").cast("decimal(28,8)").alias("savings_usd"),
        F.grouping_id().alias("gid"),
    )
    # Bits of the grouping id: team, model, feature, day (set when rolled up).
    section = (
        F.when(F.col("gid") == 0b0111, F.lit("total"))
        .when(F.col("gid") == 0b0011, F.lit("model"))
        .when(F.col("gid") == 0b0101, F.lit("feature"))
        .otherwise(F.lit("day"))
    )
    label = F.coalesce("model_used", "feature_tag", F.date_format("day", "yyyy-MM-dd"), F.lit(""))
    whole = F.col("section") == "total"
    return (
        sets.withColumn("section", section)
        .withColumn("label", label)
        .withColumn("spent_usd", F.col("cost_usd") - F.col("savings_usd"))
        .withColumn(
            "projected_monthly_usd",
            F.when(whole, projected_month(F.col("cost_usd").cast("double"), days)),
        )
        .select(
            "team_id",
            "section",
            "label",
            "cost_usd",
            "savings_usd",
            "spent_usd",
            "projected_monthly_usd",
        )
    )
