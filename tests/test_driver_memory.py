"""Tables that grow with the input stay off the driver: their joins are shuffled, whatever sizes Spark takes them to have."""

from fernglass.operators import components, layout
from fernglass.plans import images
from fernglass.sources import tables


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounds_of_components_broadcast_nothing(spark, monkeypatch):
    seen, plain = [], components.checkpointed
    monkeypatch.setattr(components, "checkpointed", lambda df: seen.append(planned(df)) or plain(df))
    nodes = spark.range(6).selectExpr("1 as image_id", "id")
    edges = spark.sql("select * from values (1, 0L, 1L), (1, 1L, 2L), (1, 4L, 5L) as t(image_id, a, b)")
    assert {(r.id, r.root) for r in components.components(nodes, edges).collect()} == {(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 4)}
    assert any("SortMergeJoin" in p for p in seen) and not any("Broadcast" in p for p in seen)


def test_spans_meet_points_in_a_shuffle(spark):
    spans = spark.sql("select 1 as image_id, 0.0D as low, 9.0D as high")
    points = spark.sql("select * from values (1, 4.0D, 7), (1, 12.0D, 8) as t(image_id, at, word)")
    found = layout.banded(spans, points)
    assert [r.word for r in found.collect()] == [7]
    assert planned(found).count("SortMergeJoin") >= 1  # an image's levels may be broadcast


def test_drawings_are_dealt_to_more_tasks_than_their_boxes_fill(spark):
    assert images.drawn(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == tables.dealt(spark) >= 4 * spark.sparkContext.defaultParallelism
