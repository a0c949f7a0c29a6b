"""quillspark: a Spark-first engine for ranked full-text document search."""

__version__ = "0.1.0"
