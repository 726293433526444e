"""A PySpark engine for declarative event pipelines."""
