"""readlake: archives of web reading as PySpark jobs."""

__version__ = "0.1.0"
