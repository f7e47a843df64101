"""quizloom: cohort tables -> profiled, reproducible multiple-choice question sets on Spark.

Every operator is a plain function ``DataFrame -> DataFrame`` whose work runs in
Spark SQL expressions, joins, aggregations and windows.  Randomness is a pure
function of (seed, keys) so results do not depend on partitioning.
"""

from quizloom.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
