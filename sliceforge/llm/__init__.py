"""Training-data pipeline operators.

One module per operator; ``queries`` registers them over the given tables.
Nothing outside this folder imports it.
"""
