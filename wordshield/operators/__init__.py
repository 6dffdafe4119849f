"""Detection operators over DataFrames."""
