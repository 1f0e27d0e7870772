"""Training-data operators: mixing, deduplication, filtering, extraction and token output.

Nothing outside this subpackage imports it; removing the folder leaves the rest of the library whole.
"""
