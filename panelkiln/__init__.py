"""Panel forecasting analytics on Spark DataFrames."""
