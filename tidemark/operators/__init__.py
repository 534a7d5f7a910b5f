"""Analytics over captures; each takes DataFrames and returns a DataFrame."""
