"""Refusals: a question that can't be answered safely gets a stable code instead of a number."""

from __future__ import annotations


class SemanticError(ValueError):
    def __init__(self, code: str, message: str, **details):
        super().__init__(f"{code}: {message}")
        self.code, self.details = code, details
