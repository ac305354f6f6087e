"""panelspark: Spark jobs for market time series, from landed bar files to an overfitting verdict."""
