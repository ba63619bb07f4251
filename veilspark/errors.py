"""What a statement may be refused for."""

from __future__ import annotations

from enum import StrEnum


class Cause(StrEnum):
    """Why something was refused; the labels of the rejection counters."""

    OPAQUE_NAMED_LIKE_COLUMN = "opaque_named_like_column"
    OPAQUE_ANONYMOUS = "opaque_anonymous"
    OPAQUE_AGGREGATE = "opaque_aggregate"
    OPAQUE_FUNCTION = "opaque_function"
    MASK_TYPE_MISMATCH = "mask_type_mismatch"
    NULLABILITY_MISMATCH = "nullability_mismatch"
    NO_ACTIVE_PLAN = "no_active_plan"
    COPY_STREAM = "copy_stream"
    MALFORMED = "malformed"
    HOSTILE_MASKED_USE = "hostile_masked_use"
    RATE_LIMITED = "rate_limited"
    WRITE_REFUSED = "write_refused"
    SQL_PREPARE_CURSOR = "sql_prepare_cursor"
    UNTRUSTED_FUNCTION = "untrusted_function"
    LEAKY_CATALOG = "leaky_catalog"


class PolicyRejection(Exception):
    """A statement that the policy does not let through.

    The message never holds row data.  ``sqlstate`` is 42501, or 54000 where a
    rate limit refused, or that of the error in whose place it stands; ``condition`` is
    the name of that error's class.
    """

    def __init__(self, cause: Cause, message: str, hint: str = "", sqlstate: str | None = None, condition: str | None = None) -> None:
        super().__init__(message)
        self.cause, self.message, self.hint, self.condition = cause, message, hint, condition
        self.sqlstate = sqlstate or ("54000" if cause is Cause.RATE_LIMITED else "42501")


def withheld(error: Exception, message: str) -> PolicyRejection:
    """A refusal in place of one of Spark's errors: its class and SQLSTATE, which are fixed words, and none of its text."""
    told = lambda name: getattr(error, name, lambda: None)()
    return PolicyRejection(Cause.MALFORMED, f"{message}; details are withheld", sqlstate=told("getSqlState"), condition=told("getCondition"))


class ConfigError(ValueError):
    """A policy file that cannot be used."""


class MaskError(ValueError):
    """A mask that cannot be applied to a type or value."""
