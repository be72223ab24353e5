"""Knowledge-graph growth and checking as Spark DataFrame transforms."""
