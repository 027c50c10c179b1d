"""A PySpark engine for strategy research on time series of bars, and for preparing training text."""
