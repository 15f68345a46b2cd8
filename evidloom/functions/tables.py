"""Table functions for SQL: one row to many by a lateral join, and runs of ordered rows with a state of bounded size.

A row that gives none is left out, by Spark's outer lateral join too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

Segment = tuple[float, float, str]


def hearing(backend: Callable[[str], Iterable[Segment]]):
    """A table function ``(path or text) -> (start, end, segment_id, text)`` of what the backend hears, times to two places.

    The backend may be a generator: its segments leave one by one. Null hears nothing.
    """

    class Heard:
        def eval(self, heard: str | None) -> Iterator[tuple[float, float, int, str]]:
            if heard is not None:
                for i, (a, b, t) in enumerate(backend(heard)):
                    yield round(float(a), 2), round(float(b), 2), i, t.strip()

    return udtf(Heard, returnType="start double, end double, segment_id int, text string")


def seeing(backend: Callable[[str], Iterable[tuple[float, str]]]):
    """A table function ``path -> (ts, frame_name)`` of the frames the backend takes from a video; null has none."""

    class Seen:
        def eval(self, path: str | None) -> Iterator[tuple[float, str]]:
            if path is not None:
                for ts, name in backend(path):
                    yield float(ts), name

    return udtf(Seen, returnType="ts double, frame_name string")


class _Answers:
    """Each turn with the question before it. Takes (key, turn, role, text) in the order of turns."""

    def __init__(self):
        self.asked = None

    def eval(self, row: Row) -> Iterator[tuple[int, int, int | None, str | None, str | None]]:
        key, turn, role, text = row
        if role == "user":
            self.asked = turn, text
        else:
            yield key, turn, *(self.asked or (None, None)), text


answers = udtf(_Answers, returnType="conv_id bigint, turn bigint, asked_turn bigint, question string, answer string")


def register(spark: SparkSession, **functions) -> None:
    """Makes table functions known to SQL under their names; ``answers`` always."""
    for name, function in ({"answers": answers} | functions).items():
        spark.udtf.register(name, function)
