"""Market-event analytics as PySpark DataFrame operators."""
