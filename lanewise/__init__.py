"""Road-traffic analytics and corpus preparation on PySpark DataFrames."""
