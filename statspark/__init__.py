"""A catalogue of typed table operators on Spark DataFrames."""
