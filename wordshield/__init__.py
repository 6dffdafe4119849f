"""wordshield: obfuscation-resistant text scanning on Spark DataFrames."""
