"""Voice activity of the derived runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def runs_voice(runs: DataFrame) -> DataFrame:
    """job_id, chunk_no, start_s, end_s, confidence: two stretches of speech in each chunk."""
    n = F.col("chunk_no")
    first = F.struct((n % 5 * 1.0).alias("start_s"), (n % 5 + 8.5).alias("end_s"), (n % 9 / 10 + 0.1).alias("confidence"))
    second = F.struct(F.lit(14.0).alias("start_s"), (n % 7 + 20.0).alias("end_s"), (n % 4 / 4).alias("confidence"))
    return runs.where("run_no = 0").select("job_id", "chunk_no", F.explode(F.array(first, second)).alias("s")).select("job_id", "chunk_no", "s.*")


VOICE_SQL = """heard AS (SELECT job_id, chunk_no, (chunk_no % 5)::DOUBLE AS start_s, chunk_no % 5 + 8.5 AS end_s, (chunk_no % 9) / 10 + 0.1::DOUBLE AS confidence FROM runs WHERE run_no = 0 UNION ALL SELECT job_id, chunk_no, 14.0, chunk_no % 7 + 20.0, (chunk_no % 4) / 4 FROM runs WHERE run_no = 0),
voice AS (SELECT job_id, chunk_no, sec, max(confidence) AS vad FROM (SELECT job_id, chunk_no, confidence, unnest(range(trunc(start_s)::BIGINT, trunc(end_s)::BIGINT + 1)) AS sec FROM heard) GROUP BY ALL)"""
