"""Spanish text-correction analytics on Spark."""
