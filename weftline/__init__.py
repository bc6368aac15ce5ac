"""Graph analytics and training-data operators on PySpark DataFrames."""
