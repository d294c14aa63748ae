"""Helpers that the tests import by name; fixtures are in conftest."""

from datetime import date
from decimal import Decimal

LINE_SCHEMA = ("id long, move_id long, move_name string, account_id long, journal_id long, partner_id long, company_id long, date date, "
               "date_maturity date, debit decimal(18,2), credit decimal(18,2), balance decimal(18,2), currency_id long, amount_currency decimal(18,2), "
               "ref string, name string, reconciled boolean, full_reconcile_id long, parent_state string, display_type string, followup_line_id long, "
               "followup_date date, tax_line_id long")


def day(text):
    return date.fromisoformat(text) if text else None


def money(value):
    return Decimal(str(value)).quantize(Decimal("0.01"))


def line(i, account, on, debit=0, credit=0, **more):
    """One ledger line; the rest of the columns have plain defaults."""
    names = [c.split()[0] for c in LINE_SCHEMA.split(", ")]
    row = dict.fromkeys(names)
    row.update(id=i, move_id=i, move_name=f"M{i}", account_id=account, journal_id=1, partner_id=1, company_id=1, date=day(on), debit=money(debit),
               credit=money(credit), balance=money(debit) - money(credit), currency_id=1, amount_currency=money(0), name=f"line {i}", reconciled=False,
               parent_state="posted")
    row.update({k: day(v) if k.startswith("date") and isinstance(v, str) else v for k, v in more.items()})
    return tuple(row[n] for n in names)


def rows(df, *columns):
    """Rows as plain tuples in a fixed order; decimals as floats."""
    plain = [tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in df.select(*columns or df.columns).collect()]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))
