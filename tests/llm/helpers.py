"""Documents that every operator has to bear."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000


def docs(spark, rows, extra=False):
    """rows: (doc_id, text) or (doc_id, text, lang, source); with columns that clash with helper names."""
    full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for name in ("digest", "salt", "keep_id", "fp", "fingerprint", "score", "size", "target", "position", "_id", "_source", "found", "hits", "n", "anchor", "kept"):
            df = df.withColumn(name, F.lit(f"own {name}"))
    return df


AWKWARD = [(1, None), (2, ""), (3, "   \n\t"), (4, "é ü 漢字 🙂"), (5, "same"), (6, "same"), (6, "same"), (7, LONG), (None, "no id"), (8, "\\ <| |> \x00")]
