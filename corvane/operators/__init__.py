"""Operators over DataFrames: chunking, embedding, ranking, answers, evaluation, index."""
