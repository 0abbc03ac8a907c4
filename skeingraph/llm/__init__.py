"""Training-data operators: quality, dedup, packing, language, toxicity, chat, ANN, decontamination.

Nothing outside this subpackage imports it.
"""
