"""terraloom: a PySpark-native engine for geospatial tiling and feature binding.

Every operator is a function from DataFrames to a DataFrame.  Plans are declared
with the DataFrame API so that Catalyst chooses the physical strategy; binary
encoders and mesh kernels, which no Column expression can state, run as Arrow
kernels over one tile, mesh or file at a time.
"""
