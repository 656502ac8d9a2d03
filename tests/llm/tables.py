"""Small tables as Parquet folders that queries read."""

import pandas as pd

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, folder, rows):
    """Rows (doc_id, text, source) as documents."""
    d = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    d.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def collected(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def pandas_table(path):
    return pd.read_parquet(path)
