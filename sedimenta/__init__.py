"""sedimenta: a Spark-native engine for log-structured tables, time series and corpora."""
