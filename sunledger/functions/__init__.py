"""Column expressions: numeric rules, calendar time and solar geometry."""
