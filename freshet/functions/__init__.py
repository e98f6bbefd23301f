"""Column builders: pure expressions that stay inside the JVM."""
