"""Column-level building blocks. Everything here is a Spark expression; no function runs a job."""
