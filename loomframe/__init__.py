"""An analytics engine on PySpark: ordered frames with two-valued predicates, an expression language,
a compact SQL dialect, readers and writers. Everything compiles to DataFrame plans."""

from loomframe.frame import Frame, concat, frame
from loomframe.plans.sql import sql

__all__ = ["Frame", "concat", "frame", "sql"]
__version__ = "0.1.0"
