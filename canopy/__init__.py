"""canopy: sparse trees of string nodes, their functions and analytic operators, on PySpark DataFrames."""
