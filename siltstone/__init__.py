"""siltstone: hybrid document retrieval and corpus maintenance as Spark plans."""

__version__ = "0.1.0"
