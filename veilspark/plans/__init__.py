"""Named queries over the driver's tables, each with its DuckDB twin where SQL can express it."""
