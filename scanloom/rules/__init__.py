"""Detection rules as data, and the plans that run them."""
