"""Incremental training on streams: statistics are additive and commute, so late data does no harm."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.distributions import merge


class Incremental:
    """Collects a model's statistics batch by batch, for any model with summarize() and from_summaries().

    ``arguments`` are what the model's summarize() takes after the DataFrame, such as columns, weight or label.  All batches
    but the last are kept as one sum: a retry sends the last one again, and it then replaces itself.
    """

    def __init__(self, model, *arguments, **named):
        self.start, self.arguments, self.named = model, arguments, named
        self.before: dict[str, float] = {}
        self.last: tuple[int, dict[str, float]] | None = None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        s = self.start.summarize(batch, *self.arguments, **self.named)
        if self.last is not None and self.last[0] != batch_id:
            self.before = merge(self.before, self.last[1])
        self.last = batch_id, s

    @property
    def model(self):
        """The model after all batches so far."""
        return self.start.from_summaries(self.before, self.last[1]) if self.last else self.start

    def advance(self) -> None:
        """Go on from the present model, as iterative models do between passes."""
        self.start, self.before, self.last = self.model, {}, None

    def attach(self, stream: DataFrame):
        """Start a query that feeds every micro-batch in; returns the StreamingQuery."""
        return stream.writeStream.foreachBatch(self).start()
