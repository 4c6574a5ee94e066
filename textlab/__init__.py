"""textlab: text labelling, vectorising and clustering as Spark jobs.

Every operator takes and returns DataFrames with explicit keys, so results do
not depend on row order or partitioning. Python runs only where a model is
injected (encoder, annotator, labeller) and then over Arrow batches.
"""

from textlab.config import Settings, DEFAULTS  # noqa: F401
from textlab.session import build_session, ensure_checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
