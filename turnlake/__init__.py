"""turnlake: conversation-memory analytics expressed as Spark jobs."""

__version__ = "0.1.0"
