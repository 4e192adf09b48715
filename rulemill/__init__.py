"""rulemill: grounded document retrieval and training-data preparation on Spark.

Every operator is a function from DataFrames to DataFrames; nothing in an
operator collects rows that grow with the data.
"""

__version__ = "0.1.0"
