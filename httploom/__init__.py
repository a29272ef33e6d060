"""HTTP-traffic analytics as Spark DataFrame jobs over one ``items`` table."""
