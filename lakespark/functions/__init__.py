"""Values of partitions and buckets, and statistics of columns."""
