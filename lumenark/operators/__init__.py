"""Table-in, table-out operators; each takes and returns DataFrames."""
