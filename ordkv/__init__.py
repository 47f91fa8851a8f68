"""ordkv: a versioned, ordered key-value engine over Spark DataFrames."""
