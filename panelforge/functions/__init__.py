"""Column functions: missing values, keyed random draws."""
