"""Session analytics and per-series forecasting as PySpark DataFrame jobs."""
