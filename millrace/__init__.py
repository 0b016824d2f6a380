"""Analytics over ordered, append-only message logs, expressed as Spark plans."""

__version__ = "0.1.0"
