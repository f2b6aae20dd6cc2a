"""meridion: a Spark-native analytics engine for transport-demand modelling."""
