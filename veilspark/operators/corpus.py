"""How much of a body of statements a policy serves, and why it refuses the rest.

Statements are only planned, never run.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from pathlib import Path

from ..errors import Cause, PolicyRejection
from .session import GuardedSession


@dataclass(frozen=True)
class CorpusReport:
    statements: int
    unparsed: int
    refused: int
    causes: dict[str, int]

    @property
    def refusal_rate(self) -> float:
        """Of the statements that could be analysed."""
        return self.refused / max(1, self.statements - self.unparsed)


def read_statements(folder: str | Path) -> dict[str, str]:
    """One statement a file: the .sql files of a folder, by name."""
    return {p.name: p.read_text().strip().rstrip(";") for p in sorted(Path(folder).glob("*.sql"))}


def survey(guard: GuardedSession, statements: dict[str, str], principal: str | None = None) -> CorpusReport:
    causes: Counter[str] = Counter()
    for text in statements.values():
        try:
            guard.sql(text, principal)
        except PolicyRejection as e:
            causes[e.cause.value] += 1
    unparsed = causes[Cause.MALFORMED.value]
    refused = sum(causes.values()) - unparsed
    return CorpusReport(len(statements), unparsed, refused, dict(causes))
