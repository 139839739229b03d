"""Operators for preparing language-model training data at corpus scale.

Nothing outside this package imports it but the entry and the pipeline. It stands on Spark,
numpy, pandas, pyarrow, xxhash and zstandard, and on tokenizers, tiktoken and sentencepiece
where a vocabulary is read.
"""
