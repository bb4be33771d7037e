"""Log and metric analytics as PySpark DataFrame functions and Structured Streaming jobs."""
