"""Observation time series and gridded measurements on Spark: DataFrame in, DataFrame out."""
