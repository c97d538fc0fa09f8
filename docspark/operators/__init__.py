"""Jobs on the archive's tables, as functions of DataFrames."""
