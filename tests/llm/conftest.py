import os
import sys

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odd_rows import ODD  # noqa: E402

FOLDER = "/root/testdata/sf0.001"

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                     StructField("source", StringType()), StructField("n_chars", LongType())])


@pytest.fixture(scope="session")
def spark_text(spark):
    from geoloom.llm.common import ready

    return ready(spark)


@pytest.fixture(scope="session")
def odd(spark_text):
    return spark_text.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark_text):
    return spark_text.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark_text):
    """Texts of the smallest table, as Spark rows and as Python tuples."""
    df = spark_text.read.parquet(f"{FOLDER}/documents.parquet")
    return df, [(r.doc_id, r.text) for r in df.collect()]
