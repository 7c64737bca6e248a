"""Dataset-contract and classifier-evaluation analytics on Spark."""
