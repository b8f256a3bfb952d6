"""Training-data operators: ten corpus operations built on Spark.

Nothing else in the library imports this subpackage.
"""
