"""Query catalog: importing this package registers every query."""

from codeloom.plans.catalog import (  # noqa: F401
    extract_q, graph_q, io_q, metrics_q, retrieval_q, sampling_q, scoring_q,
)
