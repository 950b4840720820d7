"""Mail-archive analytics on Spark."""
