"""sparkgate: bounded-decision analytics as Spark DataFrames."""
