"""Name -> query, and name -> SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from tidemill.operators import backtests, cross_section, dynamics, features, folds, granularity, learning, patterns, pool, ranking, regression, rolling_panel, selection, stability, studies, trajectory, validation, walk_forward, window_statistics
from tidemill.plans.flow import Flow
from tidemill.sources import bars, ingest, store
from tidemill.streaming import quotes

FLAGSHIP = "state_distribution"


def flow() -> Flow:
    made = Flow()
    for part in (bars, features, cross_section, dynamics, selection, studies, stability, validation, trajectory, backtests, walk_forward, window_statistics, pool, patterns, quotes, ingest, granularity, rolling_panel):
        part.add(made)
    return made


QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
_FLOW = flow()
for _queries, _sql in (_FLOW.registered(), folds.registered(_FLOW), quotes.registered(_FLOW), learning.registered(_FLOW), regression.registered(_FLOW), ranking.registered(_FLOW), validation.registered(_FLOW), trajectory.registered(_FLOW), walk_forward.registered(_FLOW), window_statistics.registered(_FLOW), patterns.registered(_FLOW), store.registered(_FLOW), ingest.registered(_FLOW), pool.registered(_FLOW)):
    QUERIES |= _queries
    ORACLE_SQL |= _sql
