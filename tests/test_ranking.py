import random

from pyspark.sql import functions as F

from panelloom.operators.ranking import with_position


def test_positions_follow_the_order(spark):
    draw = random.Random(1)
    rows = [(i, draw.choice(["a", "b", None]), draw.choice([1.0, 2.5, None])) for i in range(500)]
    frame = spark.createDataFrame(rows, "id int, kind string, size double").repartition(7)
    placed = with_position(frame, F.col("kind").asc(), F.col("size").desc(), F.col("id").asc()).collect()
    kinds = {None: 0, "a": 1, "b": 2}  # nulls come first, and last where the order falls
    want = sorted(rows, key=lambda r: (kinds[r[1]], r[2] is None, -(r[2] or 0), r[0]))
    assert [tuple(r)[:3] for r in sorted(placed, key=lambda r: r["position"])] == want
    assert sorted(r["position"] for r in placed) == list(range(500))
    assert with_position(frame.limit(0), F.col("id").asc()).count() == 0
