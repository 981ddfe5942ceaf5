"""Operators that prepare text documents as training data, each a function from DataFrame to DataFrame."""
