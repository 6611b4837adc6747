"""A tenant's view of an engine: every call is scoped to the tenant, checked against its scopes, and counted against its rate."""

from __future__ import annotations

import time
from collections.abc import Callable, Collection

from ..errors import EngineError, exhausted
from .engine import Engine

READS = frozenset({"list_collections", "get_collection", "points", "get_point", "list_points", "count_points", "search", "search_topk", "search_topk_batch", "search_frame", "export", "index_due"})
WRITES = frozenset({"create_collection", "delete_collection", "upsert_point", "upsert_points", "upsert_frame", "delete_point", "set_payload", "delete_payload_keys", "build_index", "import_"})
#: Calls that touch no collection.
FREE = frozenset({"distance"})


class RateWindows:
    """Fixed calendar minutes; a rejected call doesn't count. Windows over `retention` minutes old are dropped."""

    def __init__(self, per_minute: int, retention: int = 60, now: Callable[[], float] = time.time):
        self.per_minute, self.retention, self.now = per_minute, retention, now
        self.windows: dict[str, tuple[int, int]] = {}
        self._pruned = -1

    def admit(self, tenant: str) -> None:
        if not self.per_minute:
            return
        minute = int(self.now() // 60)
        if minute > self._pruned:
            self.windows = {t: w for t, w in self.windows.items() if minute - w[0] <= self.retention}
            self._pruned = minute
        at, n = self.windows.get(tenant, (minute, 0))
        n = n if at == minute else 0
        if n >= self.per_minute:
            raise exhausted("the tenant's rate limit is used up")
        self.windows[tenant] = (minute, n + 1)


class Session:
    """scopes: read, write and admin; write includes read, admin both."""

    def __init__(self, engine: Engine, tenant: str | None, scopes: Collection[str] = ("read", "write"), rates: RateWindows | None = None):
        self._engine, self._tenant, self._scopes = engine, tenant, frozenset(scopes)
        self._rates = rates or RateWindows(engine.limits.rate_per_minute, engine.limits.rate_retention_minutes)

    def _check(self, write: bool) -> None:
        wanted = {"write", "admin"} if write else {"read", "write", "admin"}
        if not self._scopes & wanted:
            raise EngineError("permission_denied", f"scope {'write' if write else 'read'} is needed")

    def __getattr__(self, name: str):
        if name not in READS | WRITES | FREE:
            raise AttributeError(name)
        call = getattr(self._engine, name)

        def run(*args, **kwargs):
            self._check(name in WRITES)
            self._rates.admit(self._tenant or "")
            return call(*args, **kwargs) if name in FREE else call(*args, **kwargs, tenant=self._tenant)

        return run
