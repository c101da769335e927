"""The queries of this subpackage and their SQL."""

from . import fingerprint, langid, media, mixing, packing, pii, quality, simhash, token_counts, toxicity

MODULES = (media, langid, mixing, simhash, packing, toxicity, token_counts, quality, fingerprint, pii)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
