"""tessera: record linkage, text profiling and corpus preparation on PySpark DataFrames."""
