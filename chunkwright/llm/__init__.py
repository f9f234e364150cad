"""Training-data operators: extraction, scoring, mixing, joins, search and decontamination.

Nothing outside this subpackage imports it. Each module holds one operator with
its own general interface; ``queries`` has the thin registered queries.
"""
