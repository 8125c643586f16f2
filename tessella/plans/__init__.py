"""The semantic plan and its lowering to DataFrames."""
