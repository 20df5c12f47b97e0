"""sparkloom: text, raster and event analytics expressed as Spark DataFrames."""
