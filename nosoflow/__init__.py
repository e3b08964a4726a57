"""Clinical-coding data engine built on Spark DataFrames."""

from nosoflow.session import build_session

__all__ = ["build_session"]
