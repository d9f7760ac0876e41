"""Training-data operators: scans, classifiers, tokenizers, packing and near-duplicate removal.

Nothing else in the library imports this subpackage; ``queries.py`` lists what it registers.
"""
