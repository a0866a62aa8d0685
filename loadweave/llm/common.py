"""What several operators share: session limits, scratch tables, text and hash helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadweave.session import prepare, shared_folder

ARROW_ROWS = 256  # rows per Arrow batch: whole texts, some of them very long, go to Python
SPACE = r"[ \t-\r]+"  # U+0020 and U+0009 to U+000D


def prepared(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small unless the user has chosen a size below ours."""
    prepare(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: it survives lost executors and cuts the plan."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(taken: list[str], wanted: str) -> str:
    """A column name that the table does not have; names are compared without case."""
    lowered = {name.lower() for name in taken}
    while wanted.lower() in lowered:
        wanted += "_"
    return wanted
