"""Column functions: text of log messages, and vectors of numbers."""
