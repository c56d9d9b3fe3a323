"""tenderflow: document analytics on Spark DataFrames."""
