"""Column expressions: null handling, calendar, units, text and scores."""
