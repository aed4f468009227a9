"""Plan building blocks: stage tables, row numbers, running aggregates, size checks."""
