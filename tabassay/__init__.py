"""Data quality, feature preparation and model evaluation as Spark DataFrame operators."""

__version__ = "0.1.0"
