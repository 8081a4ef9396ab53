"""strandflow: germline small-variant data processing as Spark DataFrames."""
