"""quarry: finds sensitive data and links in page, document and file corpora with Spark DataFrames."""

__version__ = "0.1.0"
