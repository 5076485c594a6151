"""Small document tables with awkward rows."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a table may have them too.
CLASHES = {"th": "1", "node": "2", "_id": "3", "_th": "4", "group_id": "5", "keep": "true", "_copies": "6", "_whole": "7", "tokens": "8", "n_tokens": "9", "_known": "10", "u": "11", "bit": "12"}


def docs(spark, rows, clash=False):
    """A table of (doc_id, text, lang, source) rows."""
    df = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS)
    if clash:
        from pyspark.sql import functions as F

        for name, value in CLASHES.items():
            df = df.withColumn(name, F.lit(value))
    return df


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))
