"""Training-data operators: de-duplication, mixing, extraction, tokenising, filtering.

Nothing else in the library imports this subpackage; ``__spark_entry__.py`` adds its
queries when it is present.
"""
