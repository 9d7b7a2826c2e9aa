"""logmill: a log store and log analytics engine on Spark DataFrames."""
