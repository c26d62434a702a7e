"""Voice activity: frames to speech segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a frame as the segments' clock counts it, percentile of energy, width of the moving mean,
#: weights of frame and recogniser, confidence of speech, shortest segment in seconds.
FRAME_S, PERCENTILE, WIDTH, WEIGHTS, SPEECH, SHORTEST_S = 0.02, 0.3, 5, (0.7, 1 - 0.7), 0.6, 0.1

#: Frames of a slice, the part of a stream that one task sees at least; bins that a range of energies is cut into, and how often.
SLICE, BINS, ROUNDS = 1 << 16, 1024, 2

#: Units of a confidence of 1.
UNITS = 1 << 40


def frame_energy(samples: DataFrame, hop: int) -> DataFrame:
    """samples (stream_id, idx, x) to frames (stream_id, frame_idx, energy): the sum of squares over two hops, a frame beginning at each hop.

    Squares are summed by hop first, so that a stream's samples meet in many small groups. A last, shorter frame is left out.
    """
    hops = samples.groupBy("stream_id", F.floor(F.col("idx") / hop).alias("frame_idx")).agg(F.sum(F.col("x") * F.col("x")).alias("e"), F.count("*").alias("n")).where(F.col("n") == hop)
    following = hops.select("stream_id", (F.col("frame_idx") - 1).alias("frame_idx"), F.col("e").alias("e2"))
    return hops.join(following, ["stream_id", "frame_idx"]).select("stream_id", "frame_idx", (F.col("e") + F.col("e2")).alias("energy"))


def sliced(frames: DataFrame, width: int, halo: int = 0) -> DataFrame:
    """frames with slice, the part of the stream that each lies in; with a halo, its outermost frames also stand beside the neighbouring slices, where own is false.

    Frames of a stream are numbered without gaps, so a slice and its halo is all that a window over a few frames needs: no
    stream has to be in one task, however long it is.
    """
    home = F.floor(F.col("frame_idx") / width)
    if not halo:
        return frames.withColumn("slice", home)
    near = F.sequence(F.floor((F.col("frame_idx") - halo) / width), F.floor((F.col("frame_idx") + halo) / width))
    return frames.withColumn("slice", F.explode(near)).withColumn("own", F.col("slice") == home)


def stream_percentile(frames: DataFrame, share: float = PERCENTILE, width: int = SLICE, bins: int = BINS, rounds: int = ROUNDS) -> DataFrame:
    """stream_id, slice, threshold: each stream's exact percentile of energy, interpolated, beside each slice that it has.

    The values around the wanted rank are found by counting: each round cuts the range that is left into bins, counts by slice and
    bin, and keeps the bins that hold the rank and the next. What is left after the rounds is counted by value. A task sees
    a slice of frames, or a stream's bins, or the few values left of it; equal values are one. Nulls don't count, but a slice of nulls has its stream's percentile. Between two equal
    values lies that value itself, which weights of both would miss by a rounding, so that frames of that energy would count as above it.
    """
    every = sliced(frames.select("stream_id", "frame_idx", "energy"), width).select("stream_id", "slice", "energy")
    by_slice = every.groupBy("stream_id", "slice").agg(F.count("energy").alias("n"), F.min("energy").alias("lo"), F.max("energy").alias("hi"))
    rows = every.where("energy is not null")
    whole = by_slice.groupBy("stream_id").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    rank = (F.col("n") - 1) * F.lit(share)
    bounds = whole.select("stream_id", rank.alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"))
    slices = by_slice.select("stream_id", "slice")
    first, second = F.floor("rank"), F.ceil("rank")
    order = Window.partitionBy("stream_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def inside(bounds: DataFrame) -> DataFrame:
        return rows.join(bounds.join(slices, "stream_id"), ["stream_id", "slice"]).where(F.col("energy").between(F.col("lo"), F.col("hi")))

    for _ in range(rounds):
        bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("energy") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(F.lit(0))
        parts = inside(bounds).groupBy("stream_id", "slice", bin_.alias("bin")).agg(F.count("*").alias("k"), F.min("energy").alias("lo"), F.max("energy").alias("hi"), F.first("rank").alias("rank"), F.first("below").alias("below"))
        counted = parts.groupBy("stream_id", "bin").agg(F.sum("k").alias("k"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("rank").alias("rank"), F.first("below").alias("below"))
        upto = counted.withColumn("upto", F.col("below") + F.sum("k").over(order))
        start = F.col("upto") - F.col("k")
        kept = upto.where((F.col("upto") > first) & (start <= second))
        bounds = kept.groupBy("stream_id").agg(F.first("rank").alias("rank"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(start).alias("below"))
    values = inside(bounds).groupBy("stream_id", "slice", "energy").agg(F.count("*").alias("k"), F.first("rank").alias("rank"), F.first("below").alias("below"))
    values = values.groupBy("stream_id", "energy").agg(F.sum("k").alias("k"), F.first("rank").alias("rank"), F.first("below").alias("below"))
    upto = values.withColumn("upto", F.col("below") + F.sum("k").over(order.orderBy("energy")))
    at = lambda r: F.min(F.when(F.col("upto") > r, F.col("energy")))
    found = upto.groupBy("stream_id").agg(F.first("rank").alias("rank"), at(first).alias("v1"), at(second).alias("v2"))
    between = F.when(F.col("v1") == F.col("v2"), F.col("v1")).otherwise((second - F.col("rank")) * F.col("v1") + (F.col("rank") - first) * F.col("v2"))
    return found.select("stream_id", between.alias("threshold")).join(slices, "stream_id")


def threshold(frames: DataFrame, share: float = PERCENTILE, width: int = SLICE) -> DataFrame:
    """frames (stream_id, frame_idx, energy) with threshold, the stream's percentile, and voiced, 1 where energy is above."""
    limits = stream_percentile(frames, share, width)
    return sliced(frames, width).join(limits, ["stream_id", "slice"]).drop("slice").withColumn("voiced", (F.col("energy") > F.col("threshold")).cast("double"))


def smooth(frames: DataFrame, column: str = "voiced", width: int = WIDTH, slice_: int = SLICE) -> DataFrame:
    """With smoothed: the centred moving mean, frames beyond the ends counting as 0. Each slice is seen with a halo of half the width."""
    near = Window.partitionBy("stream_id", "slice").orderBy("frame_idx").rowsBetween(-(width // 2), width // 2)
    seen = sliced(frames, slice_, width // 2)
    return seen.withColumn("smoothed", F.sum(column).over(near) / width).where("own").drop("slice", "own")


def stamp(frames: DataFrame, asr: DataFrame, rate: float, width: int = SLICE) -> DataFrame:
    """With asr: 1 for frames in a recogniser's segment (start_s, end_s) at `rate` frames a second, else 0.

    A segment is two events, where it begins and behind its end, in each slice that it reaches; frames are stamped by the
    running sum of the events before them. Nothing is made a frame at a time.
    """
    lo, hi = (F.col("start_s") * rate).cast("long"), (F.col("end_s") * rate).cast("long") - 1
    heard = asr.select("stream_id", F.greatest(lo, F.lit(0)).alias("lo"), hi.alias("hi")).where("hi >= lo")
    heard = heard.withColumn("slice", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    begins, ends = F.greatest("lo", F.col("slice") * width), F.least(F.col("hi") + 1, (F.col("slice") + 1) * width)
    events = heard.select("stream_id", "slice", F.explode(F.array(F.struct(begins.alias("at"), F.lit(1).alias("step")), F.struct(ends.alias("at"), F.lit(-1).alias("step")))).alias("e"))
    events = events.groupBy("stream_id", "slice", "e.at").agg(F.sum("e.step").alias("step"))
    rows = sliced(frames, width).select("stream_id", "slice", F.col("frame_idx").cast("long").alias("at"), F.lit(0).cast("long").alias("step"), F.struct(*frames.columns).alias("frame"))
    rows = rows.unionByName(events, allowMissingColumns=True)
    order = Window.partitionBy("stream_id", "slice").orderBy("at", F.col("frame").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("open", F.sum("step").over(order)).where("frame is not null").select("frame.*", (F.col("open") > 0).cast("double").alias("asr"))


def blend(frames: DataFrame) -> DataFrame:
    """With confidence: the weighted mean of smoothed and asr."""
    return frames.withColumn("confidence", F.col("smoothed") * WEIGHTS[0] + F.col("asr") * WEIGHTS[1])


def units(confidence: str) -> Column:
    """A confidence in whole units, halves up, whose sums are exact in every order."""
    return F.floor(F.col(confidence) * F.lit(float(UNITS)) + 0.5).cast("decimal(20,0)")


def segments(frames: DataFrame, frame_s: float = FRAME_S, speech: float = SPEECH, shortest: float = SHORTEST_S, compat: bool = True, width: int = SLICE) -> DataFrame:
    """Runs of frames above `speech`: stream_id, seg_no, start_s, end_s, duration, confidence.

    Confidences are summed in whole units of 1 / UNITS, so that means don't depend on the order of frames, slices and tasks.
    Runs are made slice by slice, and those that meet at a slice's edge are joined by their summaries, so a stream's windows hold
    its runs and not its frames. compat takes the mean from the frame that the start's seconds point back at, which rounding puts one frame early at times.
    """
    order = Window.partitionBy("stream_id", "slice").orderBy("frame_idx")
    seen = sliced(frames.select("stream_id", "frame_idx", "confidence"), width, 1).withColumn("before", F.lag("confidence").over(order))
    on = F.col("confidence") > speech
    flagged = seen.where("own").withColumn("on", on)
    flagged = flagged.withColumn("turn", F.sum((F.col("on") != F.coalesce(F.lag("on").over(order), F.lit(False))).cast("int")).over(order))
    parts = flagged.where("on").groupBy("stream_id", "slice", "turn").agg(F.min("frame_idx").alias("first"), (F.max("frame_idx") + 1).alias("stop"), F.sum(units("confidence")).alias("total"), F.count("*").alias("k"), F.min_by("before", "frame_idx").alias("earlier"))
    along = Window.partitionBy("stream_id").orderBy("first")
    fresh = (F.col("first") != F.coalesce(F.lag("stop").over(along), F.lit(-1))).cast("int")
    runs = parts.withColumn("run", F.sum(fresh).over(along)).groupBy("stream_id", "run").agg(F.min_by("earlier", "first").alias("earlier"), F.min("first").alias("first"), F.max("stop").alias("stop"), F.sum("total").alias("total"), F.sum("k").alias("k"))
    start, end = F.col("first") * F.lit(frame_s), F.col("stop") * F.lit(frame_s)
    early = F.lit(compat) & ((start / F.lit(frame_s)).cast("int") < F.col("first"))
    total = (F.col("total") + F.when(early, units("earlier")).otherwise(0)).cast("double")
    mean = total / (F.col("k") + early.cast("int")) / F.lit(float(UNITS))
    kept = runs.select("stream_id", start.alias("start_s"), end.alias("end_s"), (end - start).alias("duration"), mean.alias("confidence")).where(F.col("duration") > shortest)
    return kept.select("stream_id", F.row_number().over(Window.partitionBy("stream_id").orderBy("start_s")).alias("seg_no"), "start_s", "end_s", "duration", "confidence")


def speech_stats(segments_: DataFrame, streams: DataFrame) -> DataFrame:
    """streams (stream_id, duration_s) with num_segments, speech_ratio and mean duration, 0 without a segment."""
    sums = segments_.groupBy("stream_id").agg(F.count("*").alias("num_segments"), F.sum("duration").alias("speech_s"), F.avg("duration").alias("mean_duration"))
    out = streams.join(sums, "stream_id", "left").na.fill(0.0, ["speech_s", "mean_duration"]).na.fill(0, ["num_segments"])
    return out.withColumn("speech_ratio", F.coalesce(F.try_divide("speech_s", "duration_s"), F.lit(0.0)))
