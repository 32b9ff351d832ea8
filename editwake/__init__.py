"""Spark-native analytics for multi-edition edit streams.

Batch work is expressed as DataFrame plans, live work as Structured Streaming;
Python runs only where a format or a data structure has no Spark expression.
"""

__version__ = "0.1.0"
