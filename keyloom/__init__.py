"""keyloom: keyed, semi-structured data as typed Spark tables, and operators from DataFrames to DataFrames."""
