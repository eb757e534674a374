"""Rows that every operator must stand: nulls anywhere, empty and long texts, ties, repeats, clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox and that lazy dog of this town " * 4000
ODD = [
    (1, "the same text for two rows and a few more words so that it is not too short at all", "en", "a", 1),
    (1, "the same text for two rows and a few more words so that it is not too short at all", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \n\t ", "de", "b", 3),
    (None, "no id here but some words", "en", None, 5),
    (None, None, None, None, None),
    (7, LONG, "en", "c", None),
    (8, "x", "fr", "c", 1),
    (9, "été 😀 naïve   line", "fr", "a", 2),
]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark, *names):
    """The odd rows with more columns named as the operator's own might be."""
    from pyspark.sql import functions as F

    df = odd(spark)
    for n in names:
        df = df.withColumn(n, F.lit(f"kept {n}"))
    return df


def mapped(df):
    """With columns that hold maps, which Spark neither hashes nor groups by."""
    from pyspark.sql import functions as F

    inner = F.create_map(F.lit(1), F.lit("x"))
    return df.withColumn("map", F.create_map(F.lit("k"), F.lit("v"), F.lit("none"), F.lit(None))).withColumn("nested", F.array(F.struct(inner.alias("m"))))
