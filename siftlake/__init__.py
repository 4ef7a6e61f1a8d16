"""siftlake: content search and corpus analytics on Spark DataFrames."""
