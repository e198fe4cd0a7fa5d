"""Training-data operators: quality, packing, extraction, toxicity,
decontamination, secrets, chat repair, WARC, near duplicates, language.

Nothing else in the library imports this subpackage.
"""
