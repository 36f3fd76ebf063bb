"""Registry of the engine's queries and of their SQL oracles."""

from __future__ import annotations

FLAGSHIP = "w10_chunk_pack"

_QUERIES: dict = {}
_ORACLES: dict = {}


def register(name: str, oracle: str | None = None):
    """Decorator: registers a (spark, sf_dir) -> DataFrame query, with its oracle SQL if there is one."""

    def put(f):
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLES[name] = oracle
        return f

    return put


def queries() -> dict:
    from tessera.plans import load_all

    load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict:
    from tessera.plans import load_all

    load_all()
    return dict(_ORACLES)
