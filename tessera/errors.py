"""Statuses of an answer, and the error that carries one."""

from __future__ import annotations

from enum import Enum


class Status(str, Enum):
    OK = "ok"
    TRUNCATED = "truncated"
    NO_INDEX = "no-index"
    STALE = "stale"
    NO_SCIP = "no-scip"
    SCIP_STALE = "scip-stale"
    INVALID_QUERY = "invalid-query"
    UNSTRATIFIED = "unstratified"
    TIMEOUT = "timeout"
    BUDGET_EXCEEDED = "budget-exceeded"
    LOCKED = "locked"
    CORRUPT = "corrupt"

    @property
    def answered(self) -> bool:
        """The query has run, whatever is to be said about its rows."""
        return self in (Status.OK, Status.TRUNCATED, Status.STALE, Status.NO_SCIP, Status.SCIP_STALE)


class QueryError(Exception):
    def __init__(self, status: Status, message: str, at: int | None = None):
        super().__init__(message if at is None else f"{message} (at {at})")
        self.status, self.message, self.at = status, message, at


def invalid(message: str, at: int | None = None) -> QueryError:
    return QueryError(Status.INVALID_QUERY, message, at)
