"""Import every operator module, so that its query is registered."""

from gridlark.llm import bpe, chat, forest, hilbert, merkle, mixing, packing, quality, resample, simhash, slack, suffixes, trie  # noqa: F401
from gridlark.llm.registry import ORACLES, QUERIES  # noqa: F401
