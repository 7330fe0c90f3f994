"""Streams of query vectors against a stored matrix."""

from sievelight.streaming.queries import answer_stream, topk_batches

__all__ = ["answer_stream", "topk_batches"]
