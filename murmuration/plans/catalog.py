"""All queries over the reference's own operators and their DuckDB twins, gathered from the plan modules."""

from __future__ import annotations

from . import effects, fitting, growing, matching, mining, modelling, recurrences, relational, search, streams, tabular, textual, various

FLAGSHIP = "target_encode_mestimate"
MODULES = (tabular, textual, relational, modelling, streams, various, matching, fitting, search, growing, recurrences, mining, effects)
QUERIES: dict = {}
ORACLES: dict = {}
for _module in MODULES:
    QUERIES.update(_module.C.queries)
    ORACLES.update(_module.C.oracles)
