"""Training-data operators: tokens, classifiers, search, packing, deduplication.

Nothing else in the package imports this subpackage; ``queries`` lists what it registers.
"""
