"""Policies on streams.  Masks keep no state, so a stream is masked like a batch.

:func:`masked_stream` binds the policy once, when the query starts;
:func:`rebinding` asks for the current generation at every micro-batch, so a
reload takes effect in a running query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.session import GuardedSession


def masked_stream(session: GuardedSession, table: str, frame: DataFrame, principal: str | None = None) -> DataFrame:
    """A stream whose rows are those of a registered table."""
    return session.mask_rows_of(table, frame, principal)


def rebinding(session: GuardedSession, table: str, sink: Callable[[DataFrame, int], None], principal: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that masks each micro-batch under the policy of its moment."""

    def run(batch: DataFrame, number: int) -> None:
        sink(session.mask_rows_of(table, batch, principal), number)

    return run
