"""DataFrame operators. Each takes and returns DataFrames.

Two kinds run jobs while the result is being built: the hierarchy walks, whose loops test for an
empty frontier, and the corpus rules, which checkpoint their narrow outcome to read the corpus once.
"""
