"""NFKC as an Arrow UDF, for Spark builds without ICU."""

import unicodedata

import pandas as pd
from pyspark.sql import functions as F


@F.pandas_udf("string")
def compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))
