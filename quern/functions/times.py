"""``time:`` builtins on timestamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.registry import builtin

builtin("time:year")(lambda t: F.year(t))
builtin("time:month")(lambda t: F.month(t))
builtin("time:day")(lambda t: F.dayofmonth(t))
builtin("time:hour", "time:hours")(lambda t: F.hour(t))
builtin("time:minute", "time:minutes")(lambda t: F.minute(t))
builtin("time:second", "time:seconds")(lambda t: F.second(t))
builtin("time:now", "time:localTime")(lambda: F.current_timestamp())
builtin("time:in-seconds")(lambda t: F.unix_timestamp(t))
builtin("time:timeZone")(lambda text: F.coalesce(F.regexp_substr(text, F.lit(r"(Z|[+-][0-9]{2}:[0-9]{2})$")), F.lit("")))


@builtin("time:completedYears")
def completed_years(later, earlier):
    """Whole years between two dates: the last one counts from its month and day on."""
    early = (F.month(later) < F.month(earlier)) | ((F.month(later) == F.month(earlier)) & (F.dayofmonth(later) < F.dayofmonth(earlier)))
    return F.year(later) - F.year(earlier) - early.cast("int")
