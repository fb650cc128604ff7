"""Column expressions shared by the operators; all stay inside the JVM."""
