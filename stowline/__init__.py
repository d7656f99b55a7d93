"""Pick-flow and slotting analytics on Spark DataFrames."""
