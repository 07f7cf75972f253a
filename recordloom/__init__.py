"""Record pipelines and data-quality gates as Spark DataFrame operators."""

__version__ = "0.1.0"
