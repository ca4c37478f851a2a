"""Training-data operators: one module per operator, each on DataFrames."""
