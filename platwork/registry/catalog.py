"""All registered queries and their SQL twins."""

from __future__ import annotations

from platwork.registry import (
    face_queries,
    grid_queries,
    package_queries,
    oracle_vector,  # noqa: F401  (registers its statements)
    vector_queries,
)
from platwork.registry import oracle_face  # noqa: E402, F401  (builds on the vector tables)
from platwork.registry import oracle_package  # noqa: E402, F401

QUERIES = {
    **grid_queries.QUERIES,
    **vector_queries.QUERIES,
    **face_queries.QUERIES,
    **package_queries.QUERIES,
}
