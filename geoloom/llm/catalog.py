"""The queries of this subpackage and the SQL that they are checked against."""

from . import decontamination, language, packing, pii, quality, scoring, secrets, simhash, toxicity, urls

_ALL = (secrets, urls, packing, quality, decontamination, pii, simhash, toxicity, language, scoring)
QUERIES = {k: v for m in _ALL for k, v in m.QUERIES.items()}
SQL = {k: v for m in _ALL for k, v in getattr(m, "SQL", {}).items()}
