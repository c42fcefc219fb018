"""Analytics over sparse matrices, intervals, graphs and text, written on Spark DataFrames."""
