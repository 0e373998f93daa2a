"""Wind-turbine telemetry analytics at fleet scale, on Spark DataFrames."""
