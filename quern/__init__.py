"""A functional dataset engine on Spark DataFrames."""

from quern.dataset import Context, Dataset
from quern.operators.partitioning import CustomPartitioner, HashPartitioner, RangePartitioner
from quern.session import get_session

__all__ = ["Context", "CustomPartitioner", "Dataset", "HashPartitioner", "RangePartitioner", "get_session"]
