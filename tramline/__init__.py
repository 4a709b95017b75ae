"""Transit demand panel engine on Spark."""
