import base64
import hashlib
import struct

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from evidloom.llm import common, secrets, toxicity
from evidloom.llm.common import table
from pyspark.sql import functions as F
from test_jaccard_join import brute
from test_mixing import holds, wanted

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, D, "documents")
    model = toxicity.train(docs, table(spark, D, "labels"), F.lit(True))
    scorer, weights = toxicity.Scorer(model.toxic, model.ordinary), np.array(model.weights)
    rows = [tuple(r) for r in docs.collect()]
    outs, steps = [], dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, D)
        outs.append([tuple(r) for r in docs.collect()])
        if len(outs) < len(steps):
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(outs[-1], docs.schema)
    clean, single, redacted, mixed, ids = outs
    assert sorted(clean) == sorted(r for r in rows if toxicity._probability(np.array([scorer.features(r[1])]), weights)[0] < 0.5)
    heads = {c for _, _, c in brute([(r[0], r[1]) for r in clean])}
    assert sorted(single) == sorted(r for r in clean if r[0] in heads) and len(single) < len(clean)
    scanner = secrets.Scanner().tables()
    want = [(d, t, a, b, len(t)) for d, t, a, b in ((r[0], secrets.redacted(r[1], scanner.spans(r[1]), scanner.kinds), r[2], r[3]) for r in single)]
    assert sorted(redacted) == sorted(want) and redacted != single
    count = {r: mixed.count(r) for r in redacted}
    assert sum(count.values()) == len(mixed)
    size = lambda r: len(r[1].split())

    class Taken:
        def __init__(self, r):
            self.doc_id, self.size, self.taken, self.shards = r[0], size(r), size(r) * count[r], [0] * count[r]
            self.source_size, self.target = sums[r[3]], wanted(sums)[r[3]]

    sums = {}
    for r in redacted:
        sums[r[3]] = sums.get(r[3], 0) + size(r)
    holds([Taken(r) for r in redacted], [(r[0], r[3], size(r)) for r in redacted])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    told = []
    for r in mixed:
        found = encoding.encode_ordinary(r[1])
        told.append((r[0], len(found), hashlib.sha256(struct.pack(f"<{len(found)}I", *found)).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest(), found))
    assert sorted(told) == sorted(ids)


def test_run(spark):
    rows = corpus_pipeline.run(spark, D)
    assert {"doc_id", "n_tokens", "ids"} <= set(rows.columns) and rows.count() > 0


def test_clashing_columns(spark):
    """Documents may have columns of any name; they go through all stages but the last as they are."""
    names = ["toxicity", "secrets", "shard", "place", "sig", "sig_n", "own_sig", "row", "block", "copies", "key", "draws"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(["a secret: abcdefghijklmnopq of some kind", "the same words in both of these texts", "the same words in both of these texts", ""])] + [(None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, D)
        found = docs.collect()
        assert docs.columns == columns and all(r[n] == n for r in found for n in names)
        docs = spark.createDataFrame(found, docs.schema)
    assert {r.text for r in found} <= {"a [assign] of some kind", "the same words in both of these texts", "", None}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, D).count() == len(found)


def test_workers_keep_little_between_stages(spark):
    """Workers live from stage to stage: batches are bounded in bytes, and no task's memory of chunks stays behind."""
    docs = spark.range(400).selectExpr("id as doc_id", "repeat(concat(uuid(), ' '), 1000) as text", "'en' as lang", "'s' as source", "0L as n_chars")
    corpus_pipeline.STAGES[-1][1](spark, docs.coalesce(4), D).write.format("noop").mode("overwrite").save()

    def told(batches):
        from evidloom.llm import bpe_codec

        for b in batches:
            yield pa.RecordBatch.from_pydict({"held": [sum(c.held for c in bpe_codec._CODEC.values())], "bytes": [b.nbytes]})

    rows = docs.coalesce(1).mapInArrow(told, "held long, bytes long").collect()
    assert len(rows) > 3 and max(r.bytes for r in rows) < 2 * common.BATCH_BYTES
    held = spark.range(64).repartition(8).mapInArrow(told, "held long, bytes long").collect()
    assert not any(r.held for r in rows + held)
