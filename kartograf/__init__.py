"""Channel charting on Spark DataFrames: radio time series in, charts, positions and scores out."""
