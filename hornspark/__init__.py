"""hornspark: Horn-clause (positive Datalog) analytics on Spark DataFrames."""
