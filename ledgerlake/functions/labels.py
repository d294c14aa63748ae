"""Text columns shown by the reports."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def product_label(code: str = "code", name: str = "name") -> Column:
    """``code - name``, or the name alone when there is no code."""
    return F.concat_ws(" - ", F.col(code), F.col(name))


def ledger_display_name(*columns: str) -> Column:
    """Names joined by a dash, leaving out missing, empty and '/' parts."""
    kept = F.filter(F.array(*[F.col(c) for c in columns]), lambda x: x.isNotNull() & ~x.isin("", "/"))
    return F.array_join(kept, "-")


def partner_label(name: str = "name", key: str = "partner_id") -> Column:
    """Names of 45 or more characters are cut to 40 and dotted; no partner gives a fixed text."""
    n = F.col(name)
    cut = F.when(F.length(n) >= 45, F.concat(F.substring(n, 1, 40), F.lit("..."))).otherwise(n)
    return F.when(F.col(key).isNull(), F.lit("Unknown Partner")).otherwise(cut)


def period_labels(length: int) -> list[str]:
    """Overdue bands of equal length, newest first: ``1-30`` … ``+120``."""
    return [f"{k * length + 1}-{(k + 1) * length}" for k in range(4)] + [f"+{4 * length}"]


def bound_labels(bounds: list[int]) -> list[str]:
    """Bands given by their upper limits, preceded by the part not due."""
    starts = [1] + [b + 1 for b in bounds[:-1]]
    return ["Not Due"] + [f"{s} - {b}" for s, b in zip(starts, bounds)] + [f"{bounds[-1]} +"]


def month_name(day: str) -> Column:
    return F.date_format(F.col(day), "MMMM")


def strip_symbols(column: str) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(F.col(column), "[^a-zA-Z0-9]", "")
