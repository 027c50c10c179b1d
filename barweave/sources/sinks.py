"""Sinks, catalog and model files. All paths go through Spark, so any store it reaches will do."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_bars(bars: DataFrame, path: str, on: str = "date") -> None:
    """Parquet by symbol, sorted within: what an index on (symbol, time) is to a database."""
    bars.repartition("symbol").sortWithinPartitions("symbol", on).write.mode("overwrite").partitionBy("symbol").parquet(path)


def save_bucketed(df: DataFrame, table: str, path: str | None = None, by: str = "symbol", on: str = "date", buckets: int = 8) -> DataFrame:
    """A catalogue table in buckets of a column, sorted by time within: windows and joins by it need no exchange, nor trades.

    One file a bucket. With a path the table's files are there, else in the warehouse. Returns the table; an old one of
    that name is replaced.
    """
    writer = df.repartition(buckets, by).write.format("parquet").mode("overwrite").bucketBy(buckets, by).sortBy(by, on)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def display_rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Half-even rounding for display; engine tables keep full precision."""
    return df.withColumns({c: F.bround(c, n) for c, n in digits.items()})


def write_list(spark: SparkSession, names: list[str], path: str) -> None:
    spark.createDataFrame([(n,) for n in names], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_list(spark: SparkSession, path: str) -> list[str]:
    return [r["value"] for r in spark.read.text(path).collect()]


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrite a path that the table itself may be read from: a new folder is written, then takes the name."""
    df.write.mode("overwrite").parquet(f"{path}.new")
    _take_name(df.sparkSession, path)


def _take_name(spark: SparkSession, path: str) -> None:
    """``path.new`` becomes ``path``; what was there is ``path.old`` until it has."""
    new, old = f"{path}.new", f"{path}.old"
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(Path(path)):
        fs.delete(Path(old), True)
        if not fs.rename(Path(path), Path(old)):
            raise OSError(f"can't move {path}")
    if not fs.rename(Path(new), Path(path)):
        raise OSError(f"can't move {new}")
    fs.delete(Path(old), True)


def attach(spark: SparkSession, sf_dir: str, names: list[str], prefix: str = "") -> list[str]:
    """Register the Parquet tables of a folder as views; ``detach`` drops them."""
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(prefix + n)
    return [prefix + n for n in names]


def detach(spark: SparkSession, names: list[str]) -> None:
    for n in names:
        spark.catalog.dropTempView(n)


def tables(spark: SparkSession) -> list[str]:
    """Views and catalogue tables alike."""
    return sorted(t.name for t in spark.catalog.listTables())


def save_model(spark: SparkSession, model: dict, path: str) -> None:
    """The model as JSON; one that was there stays readable until the new one is whole."""
    spark.createDataFrame([(json.dumps(model),)], "model string").coalesce(1).write.mode("overwrite").text(f"{path}.new")
    _take_name(spark, path)


def load_model(spark: SparkSession, path: str) -> dict | None:
    """The model, or the one before if a save broke off between the two; None where there is none to read."""
    from pyspark.errors import AnalysisException

    for place in (path, f"{path}.old"):
        try:
            rows = spark.read.text(place).collect()
            return json.loads(rows[0]["value"]) if rows else None
        except AnalysisException:
            continue
        except json.JSONDecodeError:
            return None
    return None
