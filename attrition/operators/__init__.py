"""Analytical operators: each is a lazy ``f(df, ...) -> DataFrame``."""
