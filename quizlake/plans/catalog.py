"""All named queries; importing a module below registers its queries."""

from __future__ import annotations

from quizlake.plans import (  # noqa: F401
    annotation,
    encoding,
    preparation,
    runs,
    samples,
    scores,
)
from quizlake.plans.registry import QUERIES

__all__ = ["QUERIES"]
