from pyspark.sql import functions as F

from fernglass.operators import legend, tiles

WORD = "image_id string, word_idx int, text string, confidence double, x0 int, y0 int, x1 int, y1 int"


def _image(spark, name, width, height, boxes):
    """White pixels with filled boxes (x0, y0, x1, y1, colour), ends exclusive."""
    px = spark.range(width * height).select(F.lit(name).alias("image_id"), F.floor(F.col("id") / width).alias("y"), (F.col("id") % width).alias("x"))
    levels = [F.lit(255)] * 3
    for x0, y0, x1, y1, colour in boxes:
        inside = F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1)
        levels = [F.when(inside, v).otherwise(level) for v, level in zip(colour, levels, strict=True)]
    return px.select("image_id", "y", "x", *(level.cast("int").alias(c) for c, level in zip("rgb", levels, strict=True)), F.lit(255).alias("a"))


def test_legends_are_read_by_swatches_or_by_rows(spark):
    two = [(20, 20, 40, 40, (200, 30, 30)), (20, 60, 40, 80, (30, 160, 40))]
    px = _image(spark, "a", 200, 200, two).unionByName(_image(spark, "bad", 200, 200, two)).unionByName(_image(spark, "rows", 200, 100, [(5, 10, 45, 30, (128, 128, 128)), (5, 50, 45, 70, (90, 90, 90))]))
    px = px.unionByName(_image(spark, "blank", 30, 30, []))
    words = [("a", 0, "Azalea", 91.0, 45, 25, 80, 35), ("a", 1, "Boxwood", 80.0, 45, 65, 80, 75), ("rows", 0, "Camellia", 70.0, 60, 15, 90, 25), ("rows", 1, "x", 70.0, 60, 55, 90, 65), ("bad", 0, "Azalea", 90.0, 45, 25, 80, 35)]
    drawn = tiles.of_pixels(px, 64)
    got = legend.parse(drawn, spark.createDataFrame(words, WORD), spark.createDataFrame([("bad",)], "image_id string"), 64).orderBy("image_id", "ord").collect()
    shown = [(r.image_id, r.name, r.confidence, (r.cr, r.cg, r.cb), r.min_x, r.y_start, r.y_end, (r.template.width, r.template.height, len(r.template.gray))) for r in got]
    red, green = (200, 30, 30), (30, 160, 40)
    assert shown == [
        ("a", "Azalea", 91, red, 20, None, None, (19, 19, 361)), ("a", "Boxwood", 80, green, 20, None, None, (19, 19, 361)),
        ("bad", "", 0, red, 20, None, None, (19, 19, 361)), ("bad", "", 0, green, 20, None, None, (19, 19, 361)),
        ("rows", "Camellia", 70, (128, 128, 128), None, 10, 30, (20, 20, 400)),
    ]
    assert legend.parse(drawn.limit(0), spark.createDataFrame(words, WORD)).count() == 0


def test_a_parse_goes_through_its_tiles_three_times(spark):
    px = _image(spark, "a", 200, 200, [(20, 20, 40, 40, (200, 30, 30)), (20, 60, 40, 80, (30, 160, 40))]).unionByName(_image(spark, "rows", 130, 70, [(5, 10, 25, 30, (128, 128, 128))]))
    made, seen = tiles.of_pixels(px, 64).localCheckpoint(), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    words = spark.createDataFrame([("a", 0, "Azalea", 91.0, 45, 25, 50, 35), ("rows", 0, "Camellia", 70.0, 40, 15, 90, 25)], WORD)
    got = legend.parse(made.mapInArrow(counted, made.schema), words, side=64).orderBy("image_id").collect()
    assert [(r.image_id, r.name, r.template.width) for r in got] == [("a", "Azalea", 19), ("rows", "Camellia", 20)]
    assert 0 < seen.value <= 3 * made.count()
