"""Streaming use of the scoring operators.

The analysis has no streaming logic (no unbounded source, window, state or
watermark).  What carries over to a stream is the scoring itself: every
step from the probability vector to the risk level (B1-B4) is a
stateless row projection, so the same functions apply to a
``readStream`` DataFrame unchanged.
"""

from attrition.streaming.scoring import score_stream  # noqa: F401
