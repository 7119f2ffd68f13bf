"""Column-level building blocks: everything here is a narrow, JVM-side expression."""
