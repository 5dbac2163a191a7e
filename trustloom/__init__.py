"""trustloom: label-trust analytics on Spark DataFrames."""
