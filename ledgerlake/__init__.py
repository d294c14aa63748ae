"""Set-based ERP analytics on Spark: ledgers, receivables, budgets, assets, stock and procurement."""
