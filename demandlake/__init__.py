"""demandlake: job-market and retail demand analytics on Spark DataFrames."""
