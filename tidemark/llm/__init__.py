"""Training-data operators: ten corpus operators and the queries that apply them.

Nothing outside this folder imports it; ``queries.py`` lists the queries.
"""
