"""A PySpark engine for book-page image pipelines and their relational kernels."""
