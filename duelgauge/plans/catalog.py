"""Imports every query module and exposes the filled registry."""

from duelgauge.plans import tables  # noqa: F401
from duelgauge.plans import corpus_queries  # noqa: F401
from duelgauge.plans import predict_queries  # noqa: F401
from duelgauge.plans import evaluation_queries  # noqa: F401
from duelgauge.plans import progressive_queries  # noqa: F401
from duelgauge.plans import graph_queries  # noqa: F401
from duelgauge.plans import comparison_queries  # noqa: F401
from duelgauge.plans import training_queries  # noqa: F401
from duelgauge.plans import source_queries  # noqa: F401
from duelgauge.plans import job_queries  # noqa: F401
from duelgauge.plans.registry import ORACLES, QUERIES  # noqa: F401
