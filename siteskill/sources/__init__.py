"""Reading, writing and reshaping of tables."""
