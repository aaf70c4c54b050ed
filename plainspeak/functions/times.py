"""Epoch-second functions; text is in the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def parse_epoch(text: Column | str) -> Column:
    """Text to epoch seconds; malformed gives NULL."""
    return _column(text).try_cast("double")


def event_time(epoch: Column | str) -> Column:
    """Epoch seconds to a timestamp, to the microsecond; not a number gives NULL."""
    micros = F.round(_column(epoch) * 1000000).try_cast("bigint")
    return F.timestamp_micros(micros)


def minute_text(epoch: Column | str) -> Column:
    return F.date_format(event_time(epoch), V.MINUTE_FORMAT)


def clock_text(epoch: Column | str) -> Column:
    return F.date_format(event_time(epoch), V.CLOCK_FORMAT)


def date_text(epoch: Column | str) -> Column:
    return F.date_format(event_time(epoch), V.DATE_FORMAT)


def capture_epoch() -> Column:
    """Now, as epoch seconds with fraction; for stamping rows at intake."""
    return F.unix_micros(F.current_timestamp()) / 1e6
