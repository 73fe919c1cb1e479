"""Sales metrics, signals, findings and insights as Spark DataFrame operators."""
