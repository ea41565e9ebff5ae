"""shardloom: logical tables over sharded Parquet, queried with Spark."""
