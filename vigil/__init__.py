"""vigil: user-activity analytics on Spark.

Every operator is a function from DataFrames to DataFrames.  Nothing in the
library collects data to the driver on a data path; the few driver-side
values (row counts for adaptive defaults, a fitted model) are scalars or
models whose size does not grow with the data.
"""

__version__ = "0.1.0"
