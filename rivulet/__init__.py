"""rivulet: event-stream SQL and stateful functions on Spark."""

__version__ = "0.1.0"
