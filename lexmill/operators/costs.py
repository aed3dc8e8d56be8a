"""Usage, prices and budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCAL_MONTHLY_USD = 60.0
LOCAL_TOKENS_PER_S = 8.0


Prices = Sequence[tuple[str, float, float]]  # model, US dollars per million tokens in and out


def priced(usage: DataFrame, prices: Prices) -> DataFrame:
    """Every usage row with every model of the price list and its cost. The list is short: it travels in the plan."""
    cells = F.array(
        *[F.struct(F.lit(m).alias("model"), F.lit(i).alias("p_in"), F.lit(o).alias("p_out")) for m, i, o in prices]
    )
    r = usage.select("*", F.inline(cells))
    return r.withColumn(
        "usd", F.col("tokens_in") / 1_000_000 * F.col("p_in") + F.col("tokens_out") / 1_000_000 * F.col("p_out")
    )


def session_range(usage: DataFrame, key: str, prices: Prices) -> DataFrame:
    """Cheapest and dearest model per session."""
    at = F.struct("usd", "model")
    p = priced(usage, prices).groupBy(key).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    return p.select(
        key, F.col("lo.model").alias("cheapest"), F.col("lo.usd").alias("min_usd"),
        F.col("hi.model").alias("dearest"), F.col("hi.usd").alias("max_usd"),
    )


def cost_table(total: DataFrame, prices: Prices, requests_per_day: int = 2000, days: int = 30) -> DataFrame:
    """Per model from one usage row (tokens_in, tokens_out, requests): per request, per 1000,
    monthly, input share, and the daily volume at which the API costs more than one local server
    (null when one server cannot generate that much)."""
    mean = total.select(
        (F.col("tokens_in") / F.col("requests")).alias("tokens_in"), (F.col("tokens_out") / F.col("requests")).alias("tokens_out")
    )
    c = priced(mean, prices)
    volume = F.floor(F.lit(LOCAL_MONTHLY_USD) / F.col("usd") / days) + 1
    capacity = LOCAL_TOKENS_PER_S * 86400 * 30
    return c.select(
        "model", F.col("usd").alias("per_request"), (F.col("usd") * 1000).alias("per_1000"),
        (F.col("usd") * requests_per_day * days).alias("monthly"),
        (F.col("tokens_in") / 1_000_000 * F.col("p_in") / F.col("usd")).alias("input_share"),
        F.when(volume * F.col("tokens_out") * days <= capacity, volume).alias("break_even_per_day"),
    )


def compare_modes(summary: DataFrame, team: str, baseline: str) -> DataFrame:
    """Quality gained in points and tokens spent, one mode against another."""
    def of(mode: str, col: str):
        return F.max(F.when(F.col("mode") == mode, F.col(col)))

    both = summary.agg(of(team, "quality").alias("q1"), of(team, "tokens").alias("t1"), of(baseline, "quality").alias("q0"), of(baseline, "tokens").alias("t0"))
    j = both.where(F.col("q1").isNotNull() & F.col("q0").isNotNull())
    dq = (F.col("q1") - F.col("q0")) * 100
    return j.select(
        F.lit(team).alias("mode"), F.lit(baseline).alias("baseline"), F.round(dq, 4).alias("points"),
        F.round(F.try_divide("t1", "t0"), 4).alias("token_ratio"), (dq > 0).alias("paid_off"),
    )
