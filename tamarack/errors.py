"""Errors of the engine, by the stage that finds them."""

from __future__ import annotations


class TamarackError(Exception):
    """Base of all errors of the engine."""


class ParserError(TamarackError):
    """Syntax, or an unknown type; carries the place."""

    def __init__(self, message: str, line: int = 1, column: int = 1) -> None:
        super().__init__(f"{message} at line {line}, column {column}")
        self.line, self.column = line, column


class BinderError(TamarackError):
    """Names, types, arity, misuse of aggregates, shape of an INSERT."""


class CatalogError(TamarackError):
    """A table is missing or exists already."""


class ExecutionError(TamarackError):
    """Run-time failures, such as the cosine distance of a zero vector."""


class CommitConflict(ExecutionError):
    """Another writer published the same version of a lake table first."""
