"""Text-corpus analytics as Spark DataFrame operators."""
