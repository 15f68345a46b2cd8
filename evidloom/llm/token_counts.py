"""Token counts without ids: pieces are counted once for each distinct pre-token, then joined to frequencies."""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.llm.common import text_of, written
from evidloom.llm.pretokens import Cutter

#: A token that the tokenizer takes out of the text before it cuts; it counts one.
ENDOFTEXT = "<|endoftext|>"
#: Most frequent pre-tokens that every task gets; with keys of bounded size a few megabytes whatever the data.
HEAD = 1 << 18
#: Longer pre-tokens, in bytes, go by a digest.
KEY_BYTES = 40
#: Bytes of different strings that a task holds between two flushes.
HELD_BYTES = 64 << 20
#: Texts, pre-tokens for one library call, and bytes that are taken up at a time.
TEXTS, LIBRARY, SLICE_BYTES = 256, 1024, 8 << 20
#: A string's share of the budget beside its bytes: object, table entry and count.
ENTRY = 150


def key_of(pretoken: str) -> str:
    """The pre-token itself, or for a long one its 128-bit digest behind a character that no short one begins with."""
    if len(pretoken) <= KEY_BYTES // 4 or len(data := pretoken.encode()) <= KEY_BYTES and pretoken[0] != "\1":
        return pretoken
    return "\1" + hashlib.blake2b(data, digest_size=16).hexdigest()


@dataclass(frozen=True)
class Head:
    """The most frequent keys and their piece counts, as flat arrays that a worker makes a table of once."""

    keys: pa.Array
    pieces: pa.Array

    @classmethod
    def of(cls, rows: pa.Table) -> Head:
        return cls(rows.column("key").cast(pa.string()).combine_chunks(), rows.column("n_pieces").combine_chunks())

    def table(self) -> dict[str, int]:
        return dict(zip(self.keys.to_pylist(), self.pieces.to_pylist(), strict=True))


def _parts(cutter: Cutter, text: str, special: str) -> tuple[list[str], list[str], int]:
    """Strings to cut alone, chunks to cut with a space before, and the number of special tokens."""
    alone, chunks, pieces = [], [], text.split(special)
    for piece in pieces:
        a, c = cutter.chunks(piece)
        alone += a
        chunks += c
    return alone, chunks, len(pieces) - 1


def pretoken_frequencies(docs: DataFrame, pattern: str, special: str) -> DataFrame:
    """How often each distinct pre-token is in all texts; each task sends its own sums, a bounded number of bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, chunks, found = Cutter(pattern), Counter(), Counter()

        def sums():
            names, counts = list(found), list(found.values())
            found.clear()
            for lo in range(0, len(names), 1 << 14):
                yield pa.RecordBatch.from_arrays([pa.array(names[lo : lo + (1 << 14)], pa.string()), pa.array(counts[lo : lo + (1 << 14)], pa.int64())], ["pretoken", "freq"])

        def cut():
            for c, k in chunks.items():
                for p in cutter.cut(" " + c):
                    found[p] += k
            chunks.clear()

        def size() -> int:
            return 2 * (sum(map(len, chunks)) + ENTRY * len(chunks)) + sum(map(len, found)) + ENTRY * len(found)

        held = 0  # no less than what is held: texts count whole until the strings themselves are measured
        for batch in batches:
            for t in batch.column(1):
                text = t.as_py()
                alone, rest, _ = _parts(cutter, text, special)
                before = 2 * len(chunks) + len(found)
                chunks.update(rest)
                for a in alone:
                    found.update(cutter.cut(a))
                held += 2 * len(text) + ENTRY * (2 * len(chunks) + len(found) - before)
                if held > HELD_BYTES:
                    held = size()
                    if held > HELD_BYTES // 2:
                        cut()
                        yield from sums()
                        held = 0
        cut()
        yield from sums()

    return docs.mapInArrow(run, "pretoken string, freq bigint").groupBy("pretoken").agg(F.sum("freq").alias("freq"))


def count_pieces(pretokens: DataFrame, tokenizer_json: str) -> DataFrame:
    """``key``, ``freq`` and ``n_pieces`` of each distinct pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model = Tokenizer.from_str(tokenizer_json)
        model.no_truncation()
        model.no_padding()
        for batch in batches:
            for part in slices(batch, LIBRARY, SLICE_BYTES):
                names = part.column(0).to_pylist()
                n = [len(e) for e in model.encode_batch_fast(names, add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([pa.array([key_of(p) for p in names], pa.string()), part.column(1), pa.array(n, pa.int64())], ["key", "freq", "n_pieces"])

    return pretokens.select("pretoken", "freq").mapInArrow(run, "key string, freq bigint, n_pieces bigint")


def slices(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``rows`` rows and about ``size`` bytes, one row at least."""
    lo = 0
    while lo < batch.num_rows:
        many = rows
        while many > 1 and batch.slice(lo, many).nbytes > size:
            many //= 2
        yield batch.slice(lo, many)
        lo += many


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, pattern: str | None = None, special: str = ENDOFTEXT, limit: int = 512, head: int = HEAD) -> DataFrame:
    """Each row's id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Distinct pre-tokens are counted by the tokenizer once and kept as a table. A task has the ``head`` most frequent
    of them at hand, by keys of bounded size; what a text has besides goes as (row, key, frequency) to a join with
    the whole table, where no key is more frequent than those of the head. Null texts are empty: no tokens.
    ``special`` inside a text counts one. Null and repeated ids give a row for each row; other columns are left out.
    """
    spark = docs.sparkSession
    pattern = pattern or public_tokenizers.PATTERN
    with open(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer_json = f.read()
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    counted = written(count_pieces(pretoken_frequencies(own, pattern, special), tokenizer_json))
    frequent = counted.orderBy(F.desc("freq"), "key").limit(head)
    known = spark.sparkContext.broadcast(Head.of(frequent.select("key", "n_pieces").toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, common, held = Cutter(pattern), known.value.table(), 0
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]

        def look(c: str) -> int:
            """Pieces of a chunk; -1 if it has a pre-token outside the head."""
            got = [common.get(p) if len(p) <= KEY_BYTES // 4 else common.get(key_of(p)) for p in cutter.cut(" " + c)]
            return -1 if None in got else sum(got)

        class Looked(dict):
            """Chunks met before; a new one is looked up."""

            def __missing__(self, c: str) -> int:
                nonlocal held
                held += len(c) + ENTRY
                n = self[c] = look(c)
                return n


        of_chunk = Looked()
        for batch in batches:
            for part in slices(batch, TEXTS, SLICE_BYTES):
                out = [[], [], [], [], []]
                for doc, t in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    text = t.as_py()
                    alone, chunks, total = _parts(cutter, text, special)
                    rare = Counter()
                    if held > HELD_BYTES:
                        of_chunk.clear()
                        held = 0
                    counts = list(map(of_chunk.__getitem__, chunks))
                    if -1 in counts:
                        rest = [" " + c for c, n in zip(chunks, counts, strict=True) if n < 0]
                        alone += rest
                        total += len(rest)
                    total += sum(counts)
                    for a in alone:
                        for p in cutter.cut(a):
                            key = key_of(p)
                            if key in common:
                                total += common[key]
                            else:
                                rare[key] += 1
                    for column, x in zip(out, (doc, len(text.encode()), total, list(rare), list(rare.values())), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "n_bytes", "head", "rare", "freq"])

    per_doc = own.mapInArrow(run, "doc_id bigint, n_bytes bigint, head bigint, rare array<string>, freq array<bigint>")
    # Numbered rows are written, so that a task that runs again reads the same numbers.
    numbered = written(per_doc.withColumn("row", F.monotonically_increasing_id()))
    entries = numbered.select("row", F.explode(F.arrays_zip(F.col("rare").alias("key"), F.col("freq").alias("times"))).alias("e")).select("row", "e.*")
    rare = entries.join(counted.select("key", "n_pieces"), "key").select("row", (F.col("times") * F.col("n_pieces")).alias("more"))
    rows = numbered.select("row", "doc_id", "n_bytes", "head").unionByName(rare, allowMissingColumns=True)
    # ``head`` is null in what the join adds, and there only.
    sums = rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), (F.sum("head") + F.coalesce(F.sum("more"), F.lit(0))).alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
