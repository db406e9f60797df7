"""Flow-graph analytics on Spark: tables of many graphs, one job for all."""
