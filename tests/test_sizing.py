"""What is sent through the driver is small next to it."""

from pyspark.sql import functions as F

from sparkscrub.plans import sizing


def test_a_million_values_are_joined_and_not_sent():
    assert sizing.MAX_BROADCAST_BYTES <= 32 * 1024 * 1024


def test_rows_beyond_the_bounds_are_not_broadcast(spark, monkeypatch):
    monkeypatch.undo()
    rows = spark.range(1_000_000).select(F.concat(F.lit("value "), F.col("id").cast("string")).alias("value"))
    assert not sizing.fits_broadcast(rows)
    assert sizing.fits_broadcast(rows.limit(1000))
