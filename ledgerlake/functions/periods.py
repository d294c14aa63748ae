"""Report periods: naming a date range and finding the ones to compare it with.

A report compares a handful of periods, so they are small values worked out before the query is
built; ``in_periods`` then tags ledger lines with the periods they fall in, in the same scan.
"""

from calendar import monthrange
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Period:
    label: str
    start: date | None
    end: date
    kind: str = "custom"


def month_of(day: date) -> tuple[date, date]:
    return day.replace(day=1), day.replace(day=monthrange(day.year, day.month)[1])


def quarter_of(day: date) -> tuple[date, date]:
    first = 3 * ((day.month - 1) // 3) + 1
    return date(day.year, first, 1), month_of(date(day.year, first + 2, 1))[1]


def year_of(day: date) -> tuple[date, date]:
    return date(day.year, 1, 1), date(day.year, 12, 31)


def _clamped(day: date, months: int) -> date:
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    return date(year, month + 1, min(day.day, monthrange(year, month + 1)[1]))


def fiscal_year_of(day: date, last_month: int = 12, last_day: int = 31) -> tuple[date, date]:
    """Fiscal year around a day, given its closing day."""
    def closing(year: int) -> date:
        return date(year, last_month, min(last_day, monthrange(year, last_month)[1]))
    end = closing(day.year) if day <= closing(day.year) else closing(day.year + 1)
    return closing(end.year - 1) + timedelta(days=1), end


def classify(start: date, end: date, today: date, last_month: int = 12, last_day: int = 31) -> str:
    """Kind of a range: month, quarter, year, today, fiscal year, or custom."""
    if (start, end) == month_of(end):
        return "month"
    if (start, end) == quarter_of(end):
        return "quarter"
    if (start, end) == year_of(end):
        return "year"
    if (start, end) == (month_of(end)[0], today):
        return "today"
    if (start, end) == fiscal_year_of(end, last_month, last_day):
        return "fiscal year"
    return "custom"


def label(start: date | None, end: date, kind: str) -> str:
    if kind == "month":
        return end.strftime("%b %Y")
    if kind == "quarter":
        return f"Q{(end.month - 1) // 3 + 1} {end.year}"
    if kind == "year":
        return str(end.year)
    return f"{start or ''}..{end}"


def period(start: date, end: date, today: date, last_month: int = 12, last_day: int = 31) -> Period:
    kind = classify(start, end, today, last_month, last_day)
    return Period(label(start, end, kind), start, end, kind)


def earlier(base: Period, count: int, last_month: int = 12, last_day: int = 31) -> list[Period]:
    """The intervals before ``base``: of its own kind, or months when it is no regular interval."""
    out, current = [], base
    for _ in range(count):
        before = current.start - timedelta(days=1)
        if current.kind == "fiscal year":
            span, kind = fiscal_year_of(before, last_month, last_day), "fiscal year"
        elif current.kind == "quarter":
            span, kind = quarter_of(before), "quarter"
        elif current.kind == "year":
            span, kind = year_of(before), "year"
        else:
            span, kind = month_of(before), "month"
        current = Period(label(*span, kind), *span, kind)
        out.append(current)
    return out


def same_last_year(base: Period, count: int) -> list[Period]:
    """The same interval in each of the years before."""
    out, current = [], base
    for _ in range(count):
        start, end = _clamped(current.start, -12), _clamped(current.end, -12)
        if current.kind == "month":
            start, end = month_of(end)
        current = Period(label(start, end, current.kind), start, end, current.kind)
        out.append(current)
    return out


def span(periods: list[Period], day: str = "date") -> Column:
    """From the first start to the last end: what a scan needs for these periods. Without a start on one of them, only the end."""
    d = F.col(day)
    upto = d <= F.lit(max(p.end for p in periods))
    return upto & (d >= F.lit(min(p.start for p in periods))) if all(p.start for p in periods) else upto


def in_periods(lines: DataFrame, periods: list[Period], day: str = "date", name: str = "period") -> DataFrame:
    """One row per line and period that contains it; lines outside all periods are dropped."""
    d = F.col(day)
    hits = [F.when((d <= F.lit(p.end)) & (d >= F.lit(p.start) if p.start else F.lit(True)), F.lit(p.label)) for p in periods]
    return lines.filter(span(periods, day)).withColumn(name, F.explode(F.array_compact(F.array(*hits))))
