"""marram: catalogue queries, reconciliation and feeds expressed as Spark jobs."""

__version__ = "0.1.0"
