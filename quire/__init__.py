"""A PySpark engine for corpora of citable documents."""
