"""Column-expression builders; every function returns a DataFrame with
columns added through one projection, so Catalyst collapses chains of them."""
