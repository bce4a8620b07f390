"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from plyforge.llm import (
    exact_dedup,
    license_scan,
    line_dedup,
    media,
    near_dedup,
    packing,
    pieces,
    sharding,
    toxicity,
    warc,
)

_MODULES = (toxicity, near_dedup, pieces, line_dedup, sharding, license_scan, packing, warc, exact_dedup, media)

QUERIES = {m.NAME: m.query for m in _MODULES}
ORACLES = {m.NAME: m.ORACLE_SQL for m in _MODULES if m.ORACLE_SQL}
