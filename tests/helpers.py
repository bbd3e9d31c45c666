from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

START = datetime(2024, 1, 1)


def hours(spark, values, series="a", column="v"):
    """One series with the given values at consecutive hours."""
    rows = [(series, (START + timedelta(hours=i)).isoformat(sep=" "), v)
            for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"station string, timestamp string, {column} double")
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def column(df, name, order=("station", "timestamp")):
    return [r[name] for r in df.orderBy(*order).select(name).collect()]


def same_rows(a, b, digits=9):
    assert sorted(a.columns) == sorted(b.columns)
    names = sorted(a.columns)

    def canon(df):
        out = []
        for row in df.select(*names).collect():
            out.append(tuple(round(v, digits) + 0.0 if isinstance(v, float) else v for v in row))
        return sorted(out, key=lambda row: tuple((v is None, str(v)) for v in row))

    left, right = canon(a), canon(b)
    assert len(left) == len(right)
    assert left == right


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()
