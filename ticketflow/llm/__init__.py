"""Training-data operators: quality rules, decontamination, nearest
neighbours, mixing, token counts, WARC, SimHash, toxicity, PII, sharding,
packing, centroid clustering, ranked search.

Nothing else in the library imports this subpackage.
"""
