"""Training-data operators: one module each, queries and SQL in ``queries``."""
