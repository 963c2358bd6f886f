"""All registered queries of this subpackage."""

from . import bpe, decontam, licenses, lines, lm, merkle, prefix_join, resample, simhash, toxicity, trie, urls, warc  # noqa: F401
from .common import ORACLES, QUERIES  # noqa: F401
