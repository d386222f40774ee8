"""Column-level building blocks: text, regular expressions, dates."""
