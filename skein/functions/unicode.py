"""What the JVM functions lack: compatibility normalisation and decoding with Python's codecs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column | str) -> Column:
    """Compatibility composition (NFKC); null stays null."""
    return F.pandas_udf(_compose, T.StringType())(text)


def register(spark: SparkSession) -> None:
    spark.udf.register("nfkc", F.pandas_udf(_compose, T.StringType()))
