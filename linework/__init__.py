"""linework: a PySpark-native analytics engine for rasters and vector line art."""
