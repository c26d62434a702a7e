"""Chunks of a stream: of fixed length, or cut at gaps in speech."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscript.functions.similarity import bound
from tallyscript.operators.intervals import overlaps

#: Least gap and farthest gap in seconds, least share of a chunk before its end may come.
MIN_GAP_S, REACH_S, LEAST_SHARE, SHORTEST_S = 2.0, 30.0, 0.7, 0.1


def fixed_chunks(streams: DataFrame, chunk_s: float) -> DataFrame:
    """streams (stream_id, duration_s) to stream_id, chunk_no from 1, start_s, end_s: pieces of chunk_s, the last one shorter."""
    d = F.lit(float(chunk_s))
    number = F.explode(F.sequence(F.lit(0), F.ceil(F.col("duration_s") / d).cast("int") - 1)).alias("k")
    return streams.where("duration_s > 0").select("stream_id", "duration_s", number).select("stream_id", (F.col("k") + 1).alias("chunk_no"), (F.col("k") * d).alias("start_s"), F.least((F.col("k") + 1) * d, F.col("duration_s")).alias("end_s"))


def speech_gaps(segments: DataFrame, min_gap: float = MIN_GAP_S) -> DataFrame:
    """Gaps of at least min_gap between a stream's neighbouring segments: stream_id, gap_no, gap_start, gap_end, centre."""
    following = F.lead("start_s").over(Window.partitionBy("stream_id").orderBy("seg_no"))
    gaps = segments.select("stream_id", F.col("seg_no").alias("gap_no"), F.col("end_s").alias("gap_start"), following.alias("gap_end")).where(F.col("gap_end") - F.col("gap_start") >= min_gap)
    return gaps.withColumn("centre", (F.col("gap_start") + F.col("gap_end")) / 2)


def count_upto(ascending: Column, x: Column) -> Column:
    """How many values of an ascending array are at most x, by binary search."""
    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ascending) + F.lit(1))).cast("int"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        right = F.get(ascending, middle) <= x
        return F.when(s["lo"] >= s["hi"], s).when(right, F.struct((middle + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle.alias("hi")))

    return F.aggregate(halvings, F.struct(F.lit(0).alias("lo"), F.size(ascending).alias("hi")), halve, lambda s: s["lo"])


def boundaries(segments: DataFrame, streams: DataFrame, chunk_s: float, min_gap: float = MIN_GAP_S) -> DataFrame:
    """stream_id, boundary_no, boundary_s: from each cut the next one is the gap nearest to chunk_s later, if it is near enough and leaves
    enough of a chunk, else that very place.

    A stream's gaps are an ascending array; each step finds its place there by binary search and looks at the gap on either side,
    so a stream of n gaps and m cuts takes m log n steps. A stream without segments is cut at whole multiples of chunk_s.
    """
    gaps = speech_gaps(segments, min_gap).groupBy("stream_id").agg(F.array_sort(F.collect_list("centre")).alias("gaps"))
    has = segments.select("stream_id").distinct().withColumn("has", F.lit(True))
    d = F.lit(float(chunk_s))

    def nearest(ideal: Column) -> Column:
        k = count_upto(F.col("gaps"), ideal)
        sides = bound(k, lambda k: F.struct(F.get("gaps", k - 1).alias("below"), F.get("gaps", k).alias("above")))
        pick = lambda s: F.when(s["above"].isNull() | (F.abs(s["below"] - ideal) <= F.abs(s["above"] - ideal)), s["below"]).otherwise(s["above"])
        return bound(sides, pick)

    def step(state: Column, _: Column) -> Column:
        ideal = state["at"] + d
        usable = lambda g: g.isNotNull() & (F.abs(g - ideal) < REACH_S) & (g != 0) & (g > state["at"] + d * LEAST_SHARE)
        cut = bound(nearest(ideal), lambda g: F.when(usable(g), g).otherwise(ideal))
        moved = bound(cut, lambda c: F.struct(c.alias("at"), F.concat(state["cuts"], F.array(c)).alias("cuts")))
        return F.when(ideal < F.col("duration_s"), moved).otherwise(state)

    turns = F.sequence(F.lit(1), F.ceil(F.col("duration_s") / (d * LEAST_SHARE)).cast("int") + 1)
    start = F.struct(F.lit(0.0).alias("at"), F.array().cast("array<double>").alias("cuts"))
    rows = streams.where("duration_s > 0").join(has, "stream_id", "left").join(gaps, "stream_id", "left").withColumn("gaps", F.coalesce("gaps", F.array().cast("array<double>")))
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "stream_id")  # few bytes, much work: not to be put into few tasks
    whole, stop = F.lit(int(chunk_s)), F.col("duration_s").cast("int")
    plain = F.when(stop > whole, F.transform(F.sequence(F.lit(1), F.floor((stop - 1) / whole).cast("int")), lambda k: (k * whole).cast("double"))).otherwise(F.array().cast("array<double>"))
    cuts = rows.select("stream_id", F.when(F.col("has"), F.aggregate(turns, start, step)["cuts"]).otherwise(plain).alias("cuts"))
    return cuts.select("stream_id", F.posexplode("cuts").alias("boundary_no", "boundary_s")).withColumn("boundary_no", F.col("boundary_no") + 1)


def gap_chunks(cuts: DataFrame, streams: DataFrame) -> DataFrame:
    """Boundaries to chunks: each ends where the next begins, the last at the stream's end; none without positive length."""
    ends = cuts.select("stream_id", F.col("boundary_no").alias("chunk_no"), F.col("boundary_s").alias("end_s"))
    last = streams.where("duration_s > 0").join(cuts.groupBy("stream_id").agg(F.max("boundary_no").alias("n")), "stream_id", "left").select("stream_id", (F.coalesce("n", F.lit(0)) + 1).alias("chunk_no"), F.col("duration_s").alias("end_s"))
    rows = ends.unionByName(last)
    start = F.lag("end_s", 1, 0.0).over(Window.partitionBy("stream_id").orderBy("chunk_no"))
    return rows.select("stream_id", "chunk_no", start.alias("start_s"), "end_s").where("end_s > start_s")


def chunk_segments(chunks: DataFrame, segments: DataFrame, shortest: float = SHORTEST_S) -> DataFrame:
    """Segments that overlap a chunk, cut to it and counted from its start: stream_id, chunk_no, start_s, end_s, duration, confidence."""
    c = chunks.select("stream_id", "chunk_no", F.col("start_s").alias("c0"), F.col("end_s").alias("c1"))
    s = segments.select("stream_id", F.col("start_s").alias("s0"), F.col("end_s").alias("s1"), "confidence")
    met = overlaps(c, s, "stream_id", ("c0", "c1"), ("s0", "s1"))
    start, end = F.greatest(F.lit(0.0), F.col("s0") - F.col("c0")), F.least(F.col("c1") - F.col("c0"), F.col("s1") - F.col("c0"))
    return met.select("stream_id", "chunk_no", start.alias("start_s"), end.alias("end_s"), (end - start).alias("duration"), "confidence").where(F.col("duration") > shortest)


def chunk_voice(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """Per chunk: speech_ratio, num_segments, avg_confidence, 0 without a segment."""
    sums = chunk_segments(chunks, segments).groupBy("stream_id", "chunk_no").agg(F.sum("duration").alias("speech_s"), F.count("*").alias("num_segments"), F.avg("confidence").alias("avg_confidence"))
    rows = chunks.join(sums, ["stream_id", "chunk_no"], "left").na.fill(0.0, ["speech_s", "avg_confidence"]).na.fill(0, ["num_segments"])
    return rows.withColumn("speech_ratio", F.col("speech_s") / (F.col("end_s") - F.col("start_s")))


def no_voice(chunks: DataFrame) -> DataFrame:
    """Chunks with the voice activity of a stream that was not analysed."""
    return chunks.withColumn("fallback_mode", F.lit(True)).withColumn("speech_ratio", F.lit(0.0)).withColumn("num_segments", F.lit(0).cast("long")).withColumn("avg_confidence", F.lit(0.0))


def check_cuts(cuts: DataFrame) -> DataFrame:
    """cuts (expected_s, actual_s, mb) with duration_off (over a second), too_large and too_small by the sizes a host accepts."""
    return cuts.withColumn("duration_off", F.abs(F.col("actual_s") - F.col("expected_s")) > 1).withColumn("too_large", F.col("mb") > 95).withColumn("too_small", F.col("mb") < 0.1)
