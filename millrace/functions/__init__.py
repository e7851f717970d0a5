"""Column -> Column functions, all built-in expressions: they stay inside the JVM and inside generated code."""
