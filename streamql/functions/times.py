"""Times as plain numbers, session zones and the processing-time clock."""

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def interval_micros(spark: SparkSession, interval: str) -> int:
    """A day-time interval in microseconds; resolved by the planner, no job runs."""
    return int(spark.sql(f"SELECT unix_micros(TIMESTAMP'1970-01-01 00:00:00 UTC' + INTERVAL {interval}) AS m").first().m)


def micros(ts: Column, kind: T.DataType) -> Column:
    """Microseconds since 1970. A time without zone is counted as it reads, whatever the session's zone and its jumps."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(ts)
    day = F.unix_date(ts.cast("date")).cast("long") * 86_400_000_000
    of_day = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1_000_000
    return day + of_day + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def in_zone(ts: Column, zone: str | None = None) -> Column:
    """A time with local zone (TIMESTAMP) as it reads on the wall in `zone`, by default the session's."""
    wall = ts.cast("timestamp").cast("timestamp_ntz")
    return wall if zone is None else F.convert_timezone(None, F.lit(zone), wall)


def date_format_ltz(ts: Column, pattern: str, zone: str | None = None) -> Column:
    """DATE_FORMAT over a time with local zone."""
    return F.date_format(in_zone(ts, zone), pattern)


def extract_ltz(unit: str, ts: Column, zone: str | None = None) -> Column:
    """EXTRACT over a time with local zone, as a bigint; seconds whole."""
    return F.date_part(F.lit(unit), in_zone(ts, zone)).cast("bigint")


def with_proctime(df: DataFrame, name: str = "proctime", clock: datetime.datetime | None = None) -> DataFrame:
    """df with a processing-time column: the clock of the batch, one value for all its rows. clock fixes it, for replays and tests.

    Windows, interval joins and OVER aggregates then take this column as their time: rows of a
    batch are simultaneous, and those of a later micro-batch come after them.
    """
    return df.withColumn(name, F.current_timestamp() if clock is None else F.lit(clock))
