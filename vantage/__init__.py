"""Observer-centred sky analytics on Spark."""
