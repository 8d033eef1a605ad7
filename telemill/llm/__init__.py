"""Operators of a training-data pipeline: de-duplication, packing, tokens, chat, quality and toxicity."""
