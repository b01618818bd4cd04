"""reqlens — HTTP request-log analytics as composable Spark DataFrame functions.

Every public function takes and returns a ``pyspark.sql.DataFrame`` (or a
``Column`` for the expression helpers), so the same code runs on a laptop in
``local[*]`` mode and on a cluster: all heavy lifting is native Spark SQL.
"""

from reqlens.session import get_spark, shared_dir

__all__ = ["get_spark", "shared_dir"]
__version__ = "0.1.0"
