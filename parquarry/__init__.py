"""parquarry: managed Parquet datasets and SQL analytics, expressed on Spark."""

__version__ = "0.1.0"
