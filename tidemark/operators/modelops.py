"""Model gates: agreement of two models, parity with a reference, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import expr

TOLERANCE = 1e-3


def _argmax(logits: Column) -> Column:
    return F.array_position(logits, F.array_max(logits))


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, max_diff, mean_diff, max_prob_shift, flips, agreement) of two models' logits."""
    x, y = F.col(a), F.col(b)
    gaps = F.zip_with(x, y, lambda p, q: F.abs(p - q).cast("double"))
    shifts = expr.largest_gap(expr.softmax(x), expr.softmax(y))
    flip = _argmax(x) != _argmax(y)
    rows = pairs.select(F.array_max(gaps).alias("top"), F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g).alias("sum"), F.size(x).alias("k"), shifts.alias("shift"), flip.alias("flip"))
    out = rows.agg(F.count("*").alias("n"), F.max("top").alias("max_diff"), F.try_divide(F.sum("sum"), F.sum("k")).alias("mean_diff"), F.max("shift").alias("max_prob_shift"), F.count(F.when(F.col("flip"), 1)).alias("flips"))
    return out.withColumn("agreement", 1 - F.try_divide(F.col("flips"), F.col("n")))


def quantization_verdict(metrics: DataFrame) -> DataFrame:
    """Any flip rejects; else the tolerance is twice the greatest shift (three digits), 0.05 at least."""
    return metrics.withColumn("accepted", F.col("flips") == 0).withColumn(
        "tolerance", F.when(F.col("flips") == 0, F.greatest(F.bround(2 * F.col("max_prob_shift"), 3), F.lit(0.05)))
    )


def parity(samples: DataFrame, ids: str, logits: str, tolerance: float = TOLERANCE) -> DataFrame:
    """C22 (R06, R07): reference samples (text, input_ids, logits) beside our own ids and logits, row by row."""
    same = F.col("input_ids") == F.col(ids)
    gap = expr.largest_gap(F.col("logits"), F.col(logits)).cast("double")
    return samples.select(expr.shortened(F.col("text"), 60).alias("text"), same.alias("ids_match"), F.round(gap, 8).alias("max_logit_diff"), (gap <= tolerance).alias("logits_match"))


def parity_verdict(rows: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """One row that says whether all samples pass and, if not, which side is at fault."""
    out = rows.agg(
        F.count("*").alias("n"), F.every("ids_match").alias("ids_match"), F.max("max_logit_diff").alias("max_logit_diff"), F.every("logits_match").alias("logits_match")
    )
    passed = F.coalesce(F.col("ids_match") & F.col("logits_match"), F.lit(False))
    told = F.when(passed, "parity holds").when(~F.col("ids_match"), "token ids differ: the tokenizers disagree").otherwise(f"ids are equal but logits differ by over {tolerance}: the runtimes disagree")
    return out.withColumn("passed", passed).withColumn("diagnosis", told)


def promotion(runs: DataFrame, run_id: str | None = None) -> DataFrame:
    """What to do with a run (run_id, start_time, parity_passed), the latest if none is named.

    It is always registered; the alias moves (exit code 0) only if parity
    passed (else 1). No run gives no row (exit code 2).
    """
    wanted = runs if run_id is None else runs.where(F.col("run_id") == run_id)
    latest = wanted.orderBy(F.desc("start_time"), F.desc("run_id")).limit(1)
    passed = F.coalesce("parity_passed", F.lit(False))
    return latest.select("run_id", F.lit(True).alias("registered"), passed.alias("alias_moved"), F.when(passed, 0).otherwise(1).alias("exit_code"))
