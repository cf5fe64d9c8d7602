"""Three-valued tests and moments, as columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_true(c: Column) -> Column:
    return c.eqNullSafe(F.lit(True))


def is_false(c: Column) -> Column:
    return c.eqNullSafe(F.lit(False))


def not_false(c: Column) -> Column:
    return ~is_false(c)


def null_or_not(c: Column, value: str) -> Column:
    return c.isNull() | (c != value)


def moment(now: str) -> Column:
    """A timestamp without time zone, from ISO text."""
    datetime.fromisoformat(now)
    return F.lit(now).cast("timestamp_ntz")


def after(now: str, interval: str) -> Column:
    """``now`` moved by an interval such as ``7 DAYS`` or ``-24 HOURS``."""
    return moment(now) + F.expr(f"INTERVAL {interval}")


def start_of_day(now: str) -> Column:
    return F.date_trunc("day", moment(now)).cast("timestamp_ntz")


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with the columns, made once a row however often later ones read them: a generator stands between, which the optimiser does not copy expressions through."""
    made = F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()])))
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.withColumn("_once", made).select(*kept, *[F.col(f"_once.{k}").alias(k) for k in columns])


def let(value: Column, then) -> Column:
    """``then(value)`` with the value made once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
