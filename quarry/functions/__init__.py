"""Column-level functions (JVM built-ins composed): text, message parsing, paths."""
