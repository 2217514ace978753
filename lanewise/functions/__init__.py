"""Column expressions. All of them compile to JVM code; none runs Python per row."""
