"""palimpsest: compare versions of structured text at corpus scale, on Spark DataFrames."""
