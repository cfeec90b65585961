"""earshot: a Spark-first engine for spoken-audio data pipelines."""

__version__ = "0.1.0"
