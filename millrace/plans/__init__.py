"""Pipeline definitions, their checks, and what is planned from them."""
