"""Maritime tracking analytics on Spark."""
