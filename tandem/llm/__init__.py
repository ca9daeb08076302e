"""Operators of a training-data pipeline: packing, line dedup, vector near-dedup,
substring dedup, byte-level BPE, toxicity, separator scan, permutation index,
SimHash near-dedup and token output in ORC.

Nothing else in the library imports this package.
"""
