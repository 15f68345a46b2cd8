"""Lines that hold none of a table of keywords, found in one pass whatever the number of keywords."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of keywords that one automaton is made of; more keywords make more automata, which lines pass one after another.
AUTOMATON_BYTES = 4 << 20


def _automaton(words: list[str]) -> ahocorasick.Automaton:
    """All words as one automaton with failure links."""
    out = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for w in words:
        out.add_word(w)
    out.make_automaton()
    return out


def _batches(keywords: DataFrame, column: str, size: int) -> Iterator[list[str]]:
    """The keywords in parts of about ``size`` bytes; only one part is on the driver at a time."""
    known = keywords.select(F.col(column).cast("string").alias("word")).filter("word is not null").distinct()
    total = known.agg(F.sum(F.octet_length("word"))).first()[0]
    if total is None:
        return
    parts = max(1, -(-total // size))
    for i in range(parts):
        part = known.filter(F.pmod(F.xxhash64("word"), F.lit(parts)) == i) if parts > 1 else known
        if found := [r.word for r in part.collect()]:
            yield found


def without_keywords(lines: DataFrame, line_col: str, keywords: DataFrame, keyword_col: str = "keyword", automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """``lines`` whose text holds none of the keywords as it is, in any place; in the order and with the columns they have.

    Each line is read once for each automaton, to its first keyword. A null line is left out; null keywords mean
    nothing, the empty keyword is in every line. Nothing is shuffled.
    """
    at, spark = lines.columns.index(line_col), lines.sparkSession
    rows = lines.filter(F.col(line_col).isNotNull())
    for words in _batches(keywords, keyword_col, automaton_bytes):
        if "" in words:
            return rows.limit(0)
        rows = _passed(rows, at, spark.sparkContext.broadcast(_automaton(words)))
    return rows


def _passed(rows: DataFrame, at: int, automaton) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = automaton.value.iter
        for batch in batches:
            yield batch.filter(pa.array([next(search(line), None) is None for line in batch.column(at).to_pylist()], pa.bool_()))

    return rows.mapInArrow(run, rows.schema)
