"""Table, log and settings jobs written as Spark DataFrame / SQL / Structured Streaming plans."""

__version__ = "0.1.0"
