"""polyomics: multi-layer biological measurement data as Spark DataFrames."""
