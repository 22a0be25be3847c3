"""peerlens: entity-profile analytics as lazy Spark DataFrame operators.

Profiles are rows of numeric metrics grouped by a position that maps to a
cohort.  The operators normalise inside cohorts, rank peers, find the most
similar entities for every query at once, pick the best-value basket under
budget constraints for a whole table of scenarios, evaluate recommendations
against tags and render report columns.  Every operator takes and returns a
``pyspark.sql.DataFrame``; nothing is collected unless the caller acts.
"""

from peerlens.dims import Dimensions, FOOTBALL
from peerlens.schemas import ProfileSpec, BasketSpec

__all__ = ["Dimensions", "FOOTBALL", "ProfileSpec", "BasketSpec"]
