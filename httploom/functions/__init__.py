"""Column expressions: pure, JVM-side building blocks used by every operator."""
