"""Series similarity search as DataFrame plans on Spark."""
