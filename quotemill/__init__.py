"""quotemill: market order-feed analytics on PySpark."""
