"""All registered queries and their oracles."""

from __future__ import annotations

from chalkline.plans import audit_plans, bib_plans, corpus_plans, files_plans, frame_plans, join_plans, stream_plans  # noqa: F401
from chalkline.plans.catalog import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "course_audit"
