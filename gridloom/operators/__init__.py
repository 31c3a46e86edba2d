"""One module per family of analyses; every function takes and returns DataFrames."""
