"""A PySpark engine for public-health tables: every operator is a lazy DataFrame transformation with a report."""
