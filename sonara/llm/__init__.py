"""Training-data operators: ten self-contained modules and the queries that apply them."""
