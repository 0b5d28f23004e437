"""A lake-table engine on Spark: versioned tables of Parquet files, read and written as DataFrames."""
