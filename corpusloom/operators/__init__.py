"""Operators: every one takes DataFrames and gives a DataFrame; nothing is collected but bounded control figures."""
