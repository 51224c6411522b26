"""Model-card analytics as Spark DataFrame plans."""
