"""Date schedules that step from date to date.

Months are added one step at a time, so a schedule that starts on the 31st stays on the 28th once it
has met February. ``sequence`` with a month interval does not drift and is used for days only.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Step units of a schedule, as days or months.
DAY_UNITS = {"days": 1, "weeks": 7}
MONTH_UNITS = {"months": 1, "years": 12}


def month_steps(start: Column, months: Column, count: Column) -> Column:
    """``count`` dates from ``start``, each ``months`` after the one before."""
    return F.aggregate(
        F.sequence(F.lit(1), count), F.array(start),
        lambda acc, _: F.concat(acc, F.array(F.add_months(F.element_at(acc, -1), months))),
        lambda acc: F.slice(acc, 1, count))


def schedule_dates(begin: str, last: Column, period: str, interval: str) -> Column:
    """Dates from ``begin`` up to and including ``last``, in steps of ``interval`` periods."""
    start, step = F.col(begin), F.col(interval)
    days = step * F.when(F.col(period) == "weeks", DAY_UNITS["weeks"]).otherwise(DAY_UNITS["days"])
    by_day = F.transform(F.sequence(F.lit(0), F.floor(F.datediff(last, start) / days).cast("int")),
                         lambda i: F.date_add(start, (i * days).cast("int")))
    months = step * F.when(F.col(period) == "years", MONTH_UNITS["years"]).otherwise(MONTH_UNITS["months"])
    most = (F.floor(F.months_between(last, start) / months) + 2).cast("int")
    by_month = F.filter(month_steps(start, months, most), lambda d: d <= last)
    empty = F.array().cast("array<date>")
    return F.when(last < start, empty).when(F.col(period).isin(*DAY_UNITS), by_day).otherwise(by_month)


def count_steps_until(start: Column, months: Column, last: Column) -> Column:
    """How many stepped dates from ``start`` are not after ``last``."""
    most = F.greatest((F.floor(F.months_between(last, start) / months) + 2).cast("int"), F.lit(1))
    return F.size(F.filter(month_steps(start, months, most), lambda d: d <= last))
