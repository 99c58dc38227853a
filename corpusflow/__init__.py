"""corpusflow: training-corpus preparation and history-ledger analytics as Spark jobs."""

__version__ = "0.1.0"
