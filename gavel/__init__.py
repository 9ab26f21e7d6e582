"""gavel: evaluate decision models as Spark DataFrame jobs.

Every public operator maps DataFrames to DataFrames; Catalyst plans them.
"""

__version__ = "0.1.0"
