"""locusflow: count sequencing reads over genomic features with Spark DataFrames."""

from locusflow.config import CountConfig

__all__ = ["CountConfig"]
__version__ = "0.1.0"
