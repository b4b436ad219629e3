"""plumbrook: data quality, profiling, reshaping and corpus preparation on Spark DataFrames."""
