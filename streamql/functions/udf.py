"""Scalar functions of the user: a Column expression where there is one, else vectorised Python."""

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

REGISTRY: dict[str, object] = {}


def scalar_function(name: str, evaluate, returns: str, *, expression=None):
    """Register a scalar function. evaluate works value by value; expression, if given, builds the same as a Column and is preferred."""
    if expression is not None:
        REGISTRY[name] = expression
        return expression

    def call(*columns: Column) -> Column:
        @F.pandas_udf(returns)
        def run(*series: pd.Series) -> pd.Series:
            return pd.Series([evaluate(*(None if pd.isna(v) else v for v in row)) for row in zip(*series)], dtype=object)

        return run(*columns)

    REGISTRY[name] = call
    return call


def register_sql(spark: SparkSession, name: str, evaluate, returns: str) -> None:
    """Make a scalar function callable from spark.sql()."""
    spark.udf.register(name, F.udf(evaluate, returns, useArrow=True))
