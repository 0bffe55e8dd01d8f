"""Song-catalogue and text-corpus engine on Spark DataFrames."""
