"""Column expressions: money text, dates, account names and line order."""
