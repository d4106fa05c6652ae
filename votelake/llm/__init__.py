"""Training-data preparation operators: dedup, media columns, PII, sharding,
mixing, BPE, licences, boilerplate lines, toxicity and near-duplicates.

Each module keeps a general operator; ``queries`` derives the contract columns.
"""
