"""Column-in, column-out functions: everything here stays inside the JVM."""
