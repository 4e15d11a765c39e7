"""Small helpers shared by the query modules."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def r(c: str | Column, d: int = 6) -> Column:
    """Rounded double without negative zero, as every float output is compared.

    Scaled, rounded and scaled back in binary, as the SQL's ``round`` is: Spark's own rounds the printed digits, so that a value printed as a half may
    differ in its last digit.
    """
    c = F.col(c) if isinstance(c, str) else c
    scale = F.lit(10.0**d)
    return F.round(c.cast("double") * scale) / scale + F.lit(0.0)


def rr(d: int = 6, **cols: Column) -> list[Column]:
    return [r(c, d).alias(n) for n, c in cols.items()]


def big(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")
