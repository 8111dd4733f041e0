"""Device-failure analytics on Spark: daily sensor snapshots in, labelled sets, window statistics, gates and metrics out."""
