"""Column functions: dates with boundary semantics, text, nested values, naming rules."""
