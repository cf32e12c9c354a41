"""Set-at-a-time operators over transaction DataFrames."""
