"""A Spark-native engine for feature x sample grids: scalars, traces, statistics and selection."""
