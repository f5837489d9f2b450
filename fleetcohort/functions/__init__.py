"""Column-expression helpers; everything here stays inside JVM code generation."""
