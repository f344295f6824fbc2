"""Document analytics on Spark: geometry, layout, metrics, governance and text operators as DataFrame functions."""

__version__ = "0.1.0"
