"""Incremental runs of the per-file operators over a growing corpus.

The analysed data model has no event time, so there are no watermarks or
windows here: new content files are picked up as they land and the same
DataFrame operators run on each micro-batch.
"""

from codecensus.streaming.incremental import (  # noqa: F401
    latest_totals, stream_file_metrics, stream_repo_metric_totals)
