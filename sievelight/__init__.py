"""Sievelight: approximate top-K similarity search over large sparse and dense matrices, on Spark DataFrames."""
