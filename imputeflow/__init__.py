"""Missing-data injection, imputation and evaluation as Spark jobs."""

from imputeflow.spec import TableSpec

__all__ = ["TableSpec"]
