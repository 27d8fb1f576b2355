"""Evidence-grounded dataset building and scoring on Spark DataFrames."""
