"""Source-card analytics on Spark."""
