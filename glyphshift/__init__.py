"""Wrong-layout text analytics on Spark."""
