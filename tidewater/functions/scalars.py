"""Column functions that several operators share."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, Window, functions as F

from ..config import DEFAULT_AGE


def exact_avg(price: str) -> Column:
    """Average over an exact decimal sum: the same on every partitioning."""
    return F.sum(F.col(price).cast("decimal(18,2)")).cast("double") / F.count(price)


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def days_before(as_of: date, column: Column) -> Column:
    return F.datediff(F.lit(as_of), column).cast("long")


def age_bucket(age: Column) -> Column:
    return F.floor(F.coalesce(age, F.lit(float(DEFAULT_AGE))) / 10)


def customer_key(customer_id: Column) -> Column:
    """Last 15 hexadecimal digits: 60 bits, never negative."""
    return F.conv(F.substring(customer_id, -15, 15), 16, 10).cast("long")


def share_of(total_over: str, n: str) -> Column:
    return F.col(n).cast("double") / F.sum(n).over(Window.partitionBy(total_over))


def ranked(partition: str | list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(partition).orderBy(*order))


def linear_percentiles(column: str, points: list[float]) -> Column:
    """Exact, with linear interpolation."""
    return F.percentile(F.col(column), F.array(*map(F.lit, points)))


def image_path(article_id: Column) -> Column:
    """Ten digits, in a folder named by the first three."""
    padded = F.lpad(article_id.cast("string"), 10, "0")
    return F.concat(F.lit("images/"), F.substring(padded, 1, 3), F.lit("/"), padded, F.lit(".jpg"))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
