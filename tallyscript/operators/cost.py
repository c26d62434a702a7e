"""Estimates of cost and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prices a thousand tokens (low and high tier and the edge between them, or flat), tokens a second.
PRICES = [
    ("gemini-2.5-pro-preview-05-06", 0.00125, 0.0025, 0.010, 0.015, 200000, None, None),
    ("gemini-2.0-flash-exp", None, None, None, None, None, 0.000075, 0.0003),
    ("gemini-2.5-flash-preview-05-20", None, None, None, None, None, 0.000075, 0.0003),
]
FRAME_TOKENS, OTHER_TOKENS, OUTPUT_SHARE = 258, 32 + 10, 0.15
#: Name, runs, minutes of a chunk, voice activity, denoising, minutes in all.
PRESETS = [("quick", 1, 3, False, False, 30), ("standard", 3, 2, True, True, 90), ("high", 5, 2, True, True, 150)]
PRICE_A_GIB, MB_A_MINUTE = 0.15, 15


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, input_low double, input_high double, output_low double, output_high double, threshold long, input double, output double")


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "preset string, runs int, chunk_minutes int, vad boolean, denoise boolean, estimated_minutes int")


def tiered(tokens: Column, low: Column, high: Column, edge: Column) -> Column:
    return F.least(tokens, edge) / 1000 * low + F.greatest(tokens - edge, F.lit(0.0)) / 1000 * high


def estimate_cost(videos: DataFrame, prices_: DataFrame, v03: bool = False) -> DataFrame:
    """videos (duration_min, model, chunk_min, fps, runs) with tokens, costs (3 places) and num_chunks; an unknown model costs 0.

    Costs count every run: the total only, or in the older form tokens and all costs.
    """
    rate = FRAME_TOKENS * F.col("fps") + OTHER_TOKENS
    into = F.col("duration_min") * 60 * rate
    out = into * OUTPUT_SHARE
    rows = videos.join(F.broadcast(prices_), "model", "left")  # three rows
    cost_in = F.when(F.col("threshold").isNotNull(), tiered(into, F.col("input_low"), F.col("input_high"), F.col("threshold"))).otherwise(into / 1000 * F.coalesce("input", F.lit(0.0)))
    cost_out = F.when(F.col("threshold").isNotNull(), tiered(out, F.col("output_low"), F.col("output_high"), F.col("threshold"))).otherwise(out / 1000 * F.coalesce("output", F.lit(0.0)))
    all_runs = F.col("runs") if v03 else F.lit(1)
    return rows.select(
        *videos.columns, rate.cast("int").alias("tokens_per_second"), ((into + out).cast("long") * all_runs).alias("total_tokens"), F.greatest(F.lit(1), (F.col("duration_min") / F.col("chunk_min")).cast("int")).alias("num_chunks"),
        (F.round(cost_in, 3) * all_runs).alias("input_cost"), (F.round(cost_out, 3) * all_runs).alias("output_cost"), (F.round(cost_in + cost_out, 3) * F.col("runs")).alias("total_cost"),
    )


def estimate_time(videos: DataFrame, presets_: DataFrame) -> DataFrame:
    """videos (duration_min, mb, preset) with num_chunks, minutes (the preset's constant without a duration) and price by size."""
    rows = videos.join(F.broadcast(presets_), "preset", "left")  # three rows
    chunks = F.ceil(F.col("duration_min") / F.col("chunk_minutes"))
    each = F.lit(0.5) + F.when(F.col("vad"), 1.0).otherwise(0.0) + F.when(F.col("denoise"), 0.5).otherwise(0.0) + 2 * F.col("runs") + F.when(F.col("runs") > 1, 0.5).otherwise(0.0)
    minutes = F.when(F.coalesce("duration_min", F.lit(0.0)) == 0, F.col("estimated_minutes")).otherwise(F.floor(chunks * each + 0.5))
    return rows.select(*videos.columns, chunks.cast("long").alias("num_chunks"), minutes.cast("long").alias("minutes"), F.round(F.col("mb") / 1024 * F.col("runs") * PRICE_A_GIB, 2).alias("price"))


def guess_minutes(mb: Column) -> Column:
    return F.round(mb / MB_A_MINUTE, 1)
