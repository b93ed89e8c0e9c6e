"""All queries of the corpus operators and their SQL."""

from . import decontaminate, langid, lines, minhash, mixing, ngramjoin, quality, ranked, shards, spelling, substrings, toxicity, warc

MODULES = (warc, minhash, quality, substrings, shards, mixing, lines, decontaminate, toxicity, langid, ranked, ngramjoin, spelling)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
