"""A PySpark engine for evidence retrieval and training-data preparation."""
