"""Supply-chain graph analytics as Spark DataFrame jobs."""
