"""vellum: article enrichment, encoding and engagement-model operators on Spark."""

__version__ = "0.1.0"
