"""Driver-side state of interactive use: sessions, a token bucket and a result cache. The clock is an argument."""

from __future__ import annotations

import collections
import dataclasses
import datetime as dt
import uuid


@dataclasses.dataclass
class Session:
    session_id: str
    app_id: str
    scope: str
    last_active: dt.datetime
    ttl_seconds: int
    target: dict
    state: str = "loading"


class Sessions:
    """At most `limit` sessions of a scope (expired ones count until they are swept); a session ends ttl seconds
    after it was last used."""

    def __init__(self, limit: int = 10, ttl_seconds: int = 3600):
        self.limit, self.ttl, self.open = limit, ttl_seconds, {}

    def create(self, app_id: str, scope: str, target: dict, now: dt.datetime, ttl_seconds: int | None = None) -> Session:
        if sum(s.scope == scope for s in self.open.values()) >= self.limit:
            raise RuntimeError("too many sessions in scope")
        s = Session(f"ses:{uuid.uuid4()}", app_id, scope, now, self.ttl if ttl_seconds is None else ttl_seconds, target)
        self.open[s.session_id] = s
        return s

    def get(self, session_id: str, now: dt.datetime) -> Session:
        s = self.open[session_id]
        if (now - s.last_active).total_seconds() > s.ttl_seconds:
            raise TimeoutError("session expired")
        s.last_active = now
        return s

    def close(self, session_id: str) -> None:
        self.open.pop(session_id, None)

    def sweep(self, now: dt.datetime) -> int:
        late = [k for k, s in self.open.items() if (now - s.last_active).total_seconds() > s.ttl_seconds]
        for k in late:
            del self.open[k]
        return len(late)


class TokenBucket:
    """`rate` requests a second, `burst` at once."""

    def __init__(self, rate: float = 50.0, burst: float = 100.0):
        self.rate, self.burst, self.tokens, self.at = rate, burst, burst, None

    def allow(self, now: dt.datetime) -> bool:
        if self.at is not None:
            self.tokens = min(self.burst, self.tokens + max(0.0, (now - self.at).total_seconds()) * self.rate)
        self.at = now
        if self.tokens < 1:
            return False
        self.tokens -= 1
        return True


class ContextCache:
    """Collected contexts by request, least recently used first out; a write to a scope clears its entries. The
    exact cutoff is part of the key, so an entry never answers another time."""

    def __init__(self, size: int = 512):
        self.size, self.rows = size, collections.OrderedDict()

    @staticmethod
    def key(request) -> tuple:
        tags, scopes = (tuple(sorted(x)) if x is not None else None for x in (request.allowed_tags, request.allowed_scopes))
        return (" ".join(request.query.lower().split()), request.scope, str(request.as_of), request.budget, request.view, str(request.window_start), str(request.window_end), tags, scopes)

    def get(self, request, compute) -> list:
        k = self.key(request)
        if k not in self.rows:
            self.rows[k] = compute(request).collect()  # at most the budget's rows
            if len(self.rows) > self.size:
                self.rows.popitem(last=False)
        self.rows.move_to_end(k)
        return self.rows[k]

    def clear_scope(self, scope: str) -> None:
        for k in [k for k in self.rows if k[1] == scope]:
            del self.rows[k]
