"""Walk-forward relative-value analytics on Spark."""
