"""Column functions: every one takes and returns columns and stays inside the JVM."""
