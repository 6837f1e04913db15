"""ticketflow: support-desk analytics as Spark DataFrame jobs.

Every public function takes DataFrames (plus plain parameters such as an
explicit ``as_of`` timestamp) and returns a DataFrame. Nothing collects to
the driver; Catalyst and AQE choose the physical plan.
"""

from ticketflow.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
