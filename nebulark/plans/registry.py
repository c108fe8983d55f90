"""All registered queries of the image engine and the SQL that each is held against."""

from __future__ import annotations

from nebulark.plans import alignment, batches, carried, composites, fields, geometry, measures, previews, queries, workflows  # noqa: F401  (importing them registers their queries)

QUERIES: dict = queries.QUERIES
ORACLE: dict[str, str] = queries.ORACLE
