import random

from pyspark.sql import functions as F

from quillon import catalog
from quillon.operators import calibrate

DIR = "/root/testdata/sf0.01"


def test_pooled_is_the_max_of_min_means():
    rng = random.Random(1)
    for _ in range(200):
        n = [rng.randint(1, 9) for _ in range(rng.randint(1, 12))]
        ones = [rng.randint(0, x) for x in n]
        mean = lambda a, b: sum(ones[a : b + 1]) / sum(n[a : b + 1])  # noqa: E731, B023
        want = [max(min(mean(j, k) for k in range(i, len(n))) for j in range(i + 1)) for i in range(len(n))]
        assert all(abs(a - b) < 1e-12 for a, b in zip(calibrate.pooled(n, ones), want, strict=True))
    assert calibrate.pooled([], []) == []


def test_bins_and_edges(spark):
    rows = spark.createDataFrame([(0.25, 0), (0.25, 1), (0.65, 1), (None, 1), (0.9, None), (float("nan"), 1), (0.1, 5)], "score double, label int").withColumns({"bin": F.lit(1), "n": F.lit("clash")})
    own = calibrate.fit(rows, bins=10)
    assert own.values == [0.5] * 6 + [1.0] * 4
    got = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.59, 0.6, 1.0, 2.0, None)], "s double").select(own.probability(F.col("s")).alias("p")).collect()
    assert [r.p for r in got] == [0.5, 0.5, 0.5, 1.0, 1.0, 1.0, None]
    assert calibrate.fit(rows.limit(0), bins=4).values == [0.125, 0.375, 0.625, 0.875]
    assert calibrate.calibration_error(rows.limit(0), "score").first().asDict() == {"rows": 0, "error": None}
    two = spark.createDataFrame([(0.2, 0), (0.2, 1), (0.95, 1)], "probability double, label int")
    assert abs(calibrate.calibration_error(two).first().error - (2 * 0.3 + 0.05) / 3) < 1e-12


def test_routes(spark):
    rows = spark.createDataFrame([(0.9, 0.1), (0.4, 0.8), (0.4, None)], "r double, m double")
    got = [x[0] for x in rows.select(calibrate.routed(F.col("r"), F.col("m"), 0.8, 0.25)).collect()]
    assert got[0] == 0.9 and abs(got[1] - 0.7) < 1e-12 and got[2] == 0.4


def test_held_out_rows(spark):
    """Of texts that the model and the calibration haven't seen: small calibration error, and better order than the rules alone."""
    rows = catalog.hybrid_scores(spark, DIR).where("held_out and label is not null").cache()
    error = calibrate.calibration_error(rows, "calibrated").first()
    assert error.rows > 50 and error.error < 0.12
    raw = calibrate.calibration_error(rows, "rule").first().error
    assert error.error <= raw + 0.02
    squares = rows.agg(F.avg(F.pow(F.col("calibrated") - F.col("label"), 2)).alias("own"), F.avg(F.pow(F.col("rule") - F.col("label"), 2)).alias("rule")).first()
    assert squares.own < squares.rule
    assert rows.where("rule >= 0.8 and routed <> rule").count() == 0
    assert catalog.hybrid_scores(spark, DIR).count() == catalog.documents(spark, DIR).count()
