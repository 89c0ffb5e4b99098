"""terrane: a place-analytics engine on Spark.

Layers (attributes + a geometry struct column) and plain tables are ordinary
DataFrames; every spatial predicate and measure is a Column expression, so the
whole engine plans through Catalyst and runs on executors.
"""

from terrane.session import get_session, shared_dir  # noqa: F401
from terrane.config import StudyArea, DEFAULT_AREA  # noqa: F401

__version__ = "0.1.0"
