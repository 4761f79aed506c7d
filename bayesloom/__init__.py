"""bayesloom: Bayesian-network synthesis and evaluation of labelled tables on Spark.

Every data-heavy step (counts, information measures, family scores, CPT fitting,
sampling, prediction, evaluation) is a DataFrame job; the driver only holds
model-sized objects (column lists, edge lists, small dictionaries).
"""

from bayesloom.session import build_session, ensure_checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
