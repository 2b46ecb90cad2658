"""Multi-resolution behavioural analytics written for Spark's DataFrame API."""
