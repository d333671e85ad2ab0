"""terraspark: raster, vector, river-network and climate analytics on Spark DataFrames."""

from terraspark.session import get_session

__all__ = ["get_session"]
