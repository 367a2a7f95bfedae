"""docloom: corpus preparation, profiling and scoring for labelled long documents on Spark."""

__version__ = "0.1.0"
