"""Training-data operators: one module per operator, plus the queries registered for them."""
