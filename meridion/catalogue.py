"""Every registered query with its SQL: name -> query, name -> DuckDB SQL."""

from __future__ import annotations

from .plans import demand, more, network, streams, wider

QUERIES: dict = {**demand.Q, **network.Q, **more.Q, **streams.Q, **wider.Q}
ORACLES: dict[str, str] = {**demand.O, **network.O, **more.O, **streams.O, **wider.O}
