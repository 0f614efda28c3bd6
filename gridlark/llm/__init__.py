"""Operators for preparing text corpora for training; see `gridlark.llm.queries`."""
