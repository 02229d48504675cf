"""shelfmark: catalogue analytics (link health, record linkage, tagging) on PySpark."""

__version__ = "0.1.0"
