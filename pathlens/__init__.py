"""Journey, next-action and campaign-measurement operators on Spark DataFrames."""
