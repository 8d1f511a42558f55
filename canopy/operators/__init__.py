"""Tree, collection, analytic and search operators over DataFrames."""
