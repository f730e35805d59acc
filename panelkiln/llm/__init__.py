"""Operations on text corpora for training data, one module each.

Nothing outside this folder imports it. Every operator is a function on DataFrames; Python runs only inside tasks, on
Arrow batches that are cut by bytes, so that memory does not depend on row counts or text lengths.
"""
