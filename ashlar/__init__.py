"""A relational analytics engine expressed in PySpark DataFrames and Spark SQL."""
