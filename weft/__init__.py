"""weft: weighted rule queries and training-data operators on Spark DataFrames."""
