"""Training-data operators: one module per operator, queries beside them."""
