"""Training-data operators: near duplicates, secrets, scoring, mixing, packing.

Nothing else in the library imports this subpackage; it imports nothing of the
rest.  Every operator keeps its own general interface; ``queries.py`` holds the
thin ``opN_<name>`` wrappers that the entry module registers.
"""
