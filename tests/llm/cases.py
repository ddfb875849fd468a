"""Small tables with the awkward rows every operator has to bear."""

LONG = "Alpha beta gamma delta. " * 4000
PROSE = ("the river rose past the old mill while seven men carried sand to the wall and nobody spoke of the year before "
         "when water had stood in the church for three weeks and the bell hung silent over a brown lake that held the town "
         "until the frost came and made a road of it for carts and children")


def documents(spark, rows=None, extra=True):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and further columns with clashing names."""
    rows = rows if rows is not None else [
        (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, "", "en", "b"), (4, None, "de", None),
        (None, "no id at all here", None, "b"), (None, None, None, None), (5, LONG, "fr", "c"), (6, "   \n \n\t", "en", "c"),
        (7, "short", None, "c"), (8, PROSE + " and dogs", "en", "a"), (9, "😀 ünï\ncode ßtraße\n", "de", "d"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    if extra:
        from pyspark.sql import functions as F
        for name in ("shard", "row", "key", "kept", "class", "record", "copies", "node", "label_id", "host"):
            df = df.withColumn(name, F.lit("clash"))
        df = df.withColumn("notes", F.create_map(F.lit("k"), F.lit("v")))
    return df


def empty(spark):
    return documents(spark, []).limit(0)
