"""Constant tables: the quality ladder and the metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Name, height, max_bitrate, crf.
LADDER = [("1080p", 1080, 5_000_000, 23), ("720p", 720, 2_800_000, 23), ("480p", 480, 1_400_000, 24), ("360p", 360, 800_000, 25)]
# Metric -> tolerance; only banding is better when lower.
TOLERANCE = {"vmaf": 0.5, "vmaf_min": 0.5, "psnr_y": 0.2, "ssim": 0.001, "ms_ssim": 0.001, "ciede2000": 0.5, "cambi": 0.05}
METRICS, LOWER_IS_BETTER = list(TOLERANCE), ["cambi"]


def ladder(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(LADDER)]
    return spark.createDataFrame(rows, "pos int, rung string, rung_height long, max_bitrate long, crf int")


def tolerances(spark: SparkSession) -> DataFrame:
    rows = [(m, t, m not in LOWER_IS_BETTER) for m, t in TOLERANCE.items()]
    return spark.createDataFrame(rows, "metric string, tolerance double, higher_is_better boolean")
