"""halyard: exact classical machine learning and table analytics over Spark DataFrames."""

__version__ = "0.1.0"
