"""Small tables for the operator tests."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=SCHEMA, parts=3):
    """Documents from (doc_id, text[, lang]) rows."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, schema).repartition(parts) if full else spark.createDataFrame([], schema)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def clashing(df):
    """The same rows with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = "id row row_id norm len prefix sha open n first fp k i j t kept keep_id start length words sh pos h s win raw done found label_id toxic _html _text".split()
    return df.withColumns({c: F.lit(None).cast("string") for c in names if c not in df.columns}).withColumn("a.b`c", F.lit(1))
