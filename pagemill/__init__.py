"""Document-parsing analytics on Spark: responses, boxes, cells and text as DataFrames."""
