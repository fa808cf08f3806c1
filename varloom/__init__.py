"""varloom: Spark-native operators for variant-level summary statistics and tabular data.

Every operator takes and returns a lazy DataFrame. Nothing is collected unless
the operator's docstring states a size bound for what reaches the driver.
"""

__version__ = "0.1.0"
