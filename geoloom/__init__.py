"""geoloom: versioned, tagged, geospatial graph analytics expressed as Spark DataFrames."""
