"""Legislative-corpus analytics as Spark DataFrame transforms."""
