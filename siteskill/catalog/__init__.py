"""Queries over the test tables, one or more per operator, each with equivalent SQL where SQL can say it."""

from __future__ import annotations


def all_cases() -> dict:
    from . import density, events, levels, prep, scoring

    return {**prep.CASES, **scoring.CASES, **levels.CASES, **events.CASES, **density.CASES}
