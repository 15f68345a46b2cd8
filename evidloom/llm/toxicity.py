"""Toxicity by compression distance between two zstandard dictionaries, one for toxic and one for ordinary text.

A window is one word between its separators, before a fixed passage that both dictionaries know, so that the two
compressed lengths differ by nothing but that word. How many windows of a text gain how many bytes from the toxic
dictionary is weighed by a logistic model whose thresholds are calibrated on training labels.

Only the ordinary dictionary is trained by the library. The toxic one is made of the cores of toxic text: byte strings
that come in more toxic training texts than chance explains; it is as long as they are. That is another method than
training it too and comparing windows of several words, which misses most toxic texts (README has the figures).
Training takes a bounded sample of labelled rows; near copies in it, of whose sentences over a third were seen, teach
the dictionaries once. Scores cover all words of all texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.llm.common import giving_back

GRAM = 6
#: Defaults of ``train``: labelled texts of each class that are trained on at most, and the longest one, in bytes.
TOXIC_TEXTS, ORDINARY_TEXTS, LONGEST = 2000, 4000, 200_000
#: Texts and bytes under which the library has too little to train a dictionary on.
LEAST_TEXTS, LEAST_BYTES = 10, 4096
#: Least bytes of each trained dictionary, of them the entropy tables in front, and of the shared ordinary base.
DICTIONARY, TABLES, BASE = 1000, 200, 8192
#: The share of chance finds among chosen grams.
CHANCE = 0.05
PASSAGE = b". the window is: "
#: Gains in bytes whose windows are counted.
GAINS = (1, 2, 3, 4, 5, 6, 7, 8)
#: Longer words are cut into pieces of this many bytes, so that windows stay small.
PIECE = 64
#: Words whose gains a task remembers; above, it starts anew.
REMEMBERED = 100_000


def words(text: str) -> list[bytes]:
    found = text.lower().encode().split()
    if any(len(w) > PIECE for w in found):
        found = [w[i : i + PIECE] for w in found for i in range(0, len(w), PIECE)]
    return found


def _grams(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(a) < GRAM:
        return np.empty(0, np.uint64)
    out = np.zeros(len(a) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        out = out << np.uint64(8) | a[i : len(out) + i]
    return out


def _frequencies(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    found = [np.unique(_grams(t)) for t in texts]
    return np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)


def _at(keys: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x), np.int64)
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[i] == x, values[i], 0)


def _fresh(texts: list[str]) -> list[bytes]:
    """The texts without near copies: those of whose sentences at most a third were seen before."""
    seen, out = set(), []
    for t in texts:
        parts = [p for p in t.lower().replace("\n", ".").split(".") if len(p) > 15]
        if parts and 3 * sum(p in seen for p in parts) > len(parts):
            continue
        seen.update(parts)
        out.append(b" " + b" ".join(words(t)) + b" ")
    return out


def _beyond_chance(toxic: np.ndarray, ordinary: np.ndarray, share: float) -> np.ndarray:
    """Which grams come in more toxic texts than ``share`` of all their texts explains.

    The Chernoff bound of the binomial tail for each gram, and Benjamini and Hochberg's step-up over all of them, so
    that a gram of a language with few toxic texts needs no fixed number of them.
    """
    n = toxic + ordinary
    x = toxic / np.maximum(n, 1)
    rest = np.where(x < 1, (1 - x) * np.log(np.maximum(1 - x, 1e-300) / (1 - share)), 0)
    p = np.where(x > share, np.exp(-n * (x * np.log(np.maximum(x, 1e-300) / share) + rest)), 1.0)
    ranked = np.sort(p)
    passed = np.flatnonzero(ranked <= CHANCE * np.arange(1, len(p) + 1) / max(len(p), 1))
    return p <= ranked[passed[-1]] if len(passed) else np.zeros(len(p), bool)


def _cores(texts: list[bytes], keys: np.ndarray, count: np.ndarray) -> bytes:
    """All different stretches of chosen grams, without grams half as frequent as the stretch's best; frequent ones last.

    A stretch that a kept one holds is left out, as its bytes are there.
    """
    found: Counter[bytes] = Counter()
    for t in texts:
        f = _at(keys, count, _grams(t))
        hit = np.flatnonzero(f)
        if not len(hit):
            continue
        start = np.append(0, np.flatnonzero(np.diff(hit) > 1) + 1)
        best = np.repeat(np.maximum.reduceat(f[hit], start), np.diff(np.append(start, len(hit))))
        hit = hit[2 * f[hit] >= best]
        cut = np.flatnonzero(np.diff(hit) > 1)
        spans = zip(np.append(hit[:1], hit[cut + 1]).tolist(), (np.append(hit[cut], hit[-1:]) + GRAM).tolist(), strict=True)
        found.update({t[a:b] for a, b in spans})
    kept: list[bytes] = []
    grams: set[bytes] = set()
    for s in sorted(found, key=lambda s: (-found[s], s)):
        own = {s[i : i + GRAM] for i in range(len(s) - GRAM + 1)}
        if not own <= grams:
            grams |= own
            kept.append(s)
    return b"".join(reversed(kept))


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on the samples; what can't make one (see ``LEAST_TEXTS``, ``LEAST_BYTES``) is its own dictionary."""
    if len(samples) < LEAST_TEXTS or sum(map(len, samples)) < max(LEAST_BYTES, 2 * size):
        return b" ".join(samples)[-size:]
    return zstandard.train_dictionary(size, samples, k=48, d=6).as_bytes()


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the weights of log(1 + windows that gain at least so much), of log(1 + words), and of 1."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


class Scorer:
    def __init__(self, toxic: bytes, ordinary: bytes):
        self.compress = [self._compressor(d) for d in (toxic, ordinary)]
        self.known: dict[bytes, int] = {}

    @staticmethod
    def _compressor(raw: bytes):
        dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(5, dict_size=len(raw), source_size=128, min_match=5, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        dictionary.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=how).compress

    def gain(self, word: bytes) -> int:
        window = b" " + word + b" " + PASSAGE
        return max(0, len(self.compress[1](window)) - len(self.compress[0](window)))

    def features(self, text: str) -> list[float]:
        known, found = self.known, words(text)
        if len(known) > REMEMBERED:
            known.clear()
        gains = []
        for w in found:
            g = known.get(w)
            if g is None:
                g = known[w] = self.gain(w)
            if g:
                gains.append(g)
        return [*(sum(g >= k for g in gains) for k in GAINS), len(found)]


def _probability(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    x = np.column_stack([np.log1p(features), np.ones(len(features))])
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries and thresholds from labelled texts; without both classes the score is the constant share."""
    n = len(GAINS) + 2
    if not toxic or not ordinary:
        return Model(b" ", b" ", (0.0,) * (n - 1) + (4.0 if toxic else -4.0,))
    t, o = _fresh(toxic), _fresh(ordinary)
    (tk, tc), (ok, oc) = _frequencies(t), _frequencies(o)
    there = _at(ok, oc, tk)
    chosen = _beyond_chance(tc, there, len(t) / (len(t) + len(o)))
    base = _trained(o, BASE)
    special = _cores(t, tk[chosen], tc[chosen])
    size = max(DICTIONARY - TABLES, len(special))
    plain = _trained(o, size + TABLES)[-size:]
    dictionaries = special + base + PASSAGE, plain.rjust(len(special), b"\0")[-len(special) :] + base + PASSAGE
    scorer = Scorer(*dictionaries)
    x = np.array([scorer.features(s) for s in (*toxic, *ordinary)], float)
    y = np.repeat([1.0, 0.0], [len(toxic), len(ordinary)])
    w, z = np.zeros(n), np.column_stack([np.log1p(x), np.ones(len(x))])
    for _ in range(60):  # Newton steps of a logistic model with a small ridge
        p = _probability(x, w)
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(n), z.T @ (p - y) + 1e-2 * w)
    return Model(*dictionaries, tuple(w.tolist()))


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_texts: int = TOXIC_TEXTS, ordinary_texts: int = ORDINARY_TEXTS, longest: int = LONGEST) -> Model:
    """Fit on a bounded sample of the labelled rows for which ``learn`` holds.

    At most ``toxic_texts`` and ``ordinary_texts`` distinct texts, the first by a hash of the text, each of at most
    ``longest`` bytes, so the sample has a size bound; near copies among them teach once. Rows without a label or text
    are left out. Texts that are scored have no such bound.
    """
    own = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).filter(F.octet_length("t") <= longest).withColumn("h", F.xxhash64("t"))
    marked = labels.filter(learn).select(F.col(id_col).alias("k"), F.col(label_col).alias("y")).filter("y in (0, 1)").distinct()

    def sample(y: int, most: int) -> list[str]:
        # Only hashes meet the labels; the chosen ones, a bounded number, are then sought among the texts.
        chosen = [r.h for r in own.select("k", "h").join(marked.filter(F.col("y") == y), "k", "left_semi").select("h").distinct().orderBy("h").limit(most).collect()]
        if not chosen:
            return []
        wanted = docs.sparkSession.createDataFrame([(h,) for h in chosen], "h bigint")
        return [r.t for r in sorted(own.select("h", "t").join(F.broadcast(wanted), "h").groupBy("h").agg(F.min("t").alias("t")).collect(), key=lambda r: r.h)]

    return fit(sample(1, toxic_texts), sample(0, ordinary_texts))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``name``: the probability of label 1, from the whole text alone.

    A null text is empty. All columns and rows stay; ``name`` must be new to ``docs``.
    """
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"{name} is taken")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        scorer, weights = Scorer(m.toxic, m.ordinary), np.array(m.weights)
        for batch in batches:
            x = np.array([scorer.features(t.as_py() or "") for t in batch.column(at)], float).reshape(-1, len(GAINS) + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_probability(x, weights), pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(giving_back(run), docs.select("*", F.lit(0.0).alias(name)).schema)
