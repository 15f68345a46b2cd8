"""Evidence retrieval: candidates by inner product, then additive bonuses among the candidates alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from evidloom.functions.text import close_to, contains_folded
from evidloom.functions.vectors import dot
from evidloom.operators import knn
from evidloom.sources.stored import stored

# Bonuses, and how many candidates stand behind each result.
ASSET, MODALITY, PLACE, CONTENT, TRANSCRIPT, HEADING = 0.40, 0.20, 0.45, 0.15, 0.05, 0.10
EXPAND = 5
K = 8
#: Candidates beyond those needed, for ids that ``details`` lacks; how far their number grows before ids are joined; candidates that are broadcast.
SPARE, MOST, BROADCAST = 8, 10_000, 200_000


@dataclass(frozen=True)
class Preferences:
    """What a question prefers; None: no preference. They add to scores and never filter."""

    asset_name: str | None = None
    modality: str | None = None
    timestamp: float | None = None


def base_scores(vectors: DataFrame, query: list[float], vector_col: str = "vector") -> DataFrame:
    """``vectors`` with ``base``, the inner product with the query, for the vector; null and differently long ones are left out.

    The filter looks at the vector and not at ``base``, so the product is computed once.
    """
    whole = (F.size(vector_col) == len(query)) & ~F.exists(vector_col, lambda x: x.isNull())
    return vectors.filter(F.coalesce(whole, F.lit(False))).withColumn("base", dot(F.col(vector_col), F.array(*map(F.lit, map(float, query))))).drop(vector_col)


def bonus(query: str, prefer: Preferences) -> Column:
    """Sum of bonuses of a row with asset_name, modality, content_type, content_ref and timestamp."""
    def when(c: Column, x: float) -> Column:
        return F.when(c, F.lit(x)).otherwise(F.lit(0.0))

    parts = [when(contains_folded(F.col("content_ref"), F.lit(query)), CONTENT)]
    video, pdf = F.col("modality") == "video", F.col("modality") == "pdf"
    parts.append(F.when(video & (F.col("content_type") == "transcript_context"), F.lit(TRANSCRIPT)).when(pdf & F.col("content_type").isin("heading", "title"), F.lit(HEADING)).otherwise(F.lit(0.0)))
    if prefer.timestamp is not None:
        parts.insert(0, when(close_to(F.col("timestamp"), prefer.timestamp), PLACE))
    if prefer.modality:
        parts.insert(0, when(F.col("modality") == prefer.modality, MODALITY))
    if prefer.asset_name:
        parts.insert(0, when(contains_folded(F.col("asset_name"), F.lit(prefer.asset_name)), ASSET))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def nearest_known(vectors: DataFrame, details: DataFrame, vector: list[float], limit: int) -> list[Row]:
    """The ``limit`` nearest rows whose id ``details`` has: a few more are taken, and their ids looked up by a pushed-down filter.

    So neither table is shuffled. Where many ids are unknown the number taken grows, up to a bound; then the ids are joined.
    """
    scored, many = base_scores(vectors, vector), limit + SPARE
    while many <= MOST:
        found = scored.orderBy(F.desc("base"), "id").limit(many).collect()
        known = {r.id for r in details.filter(F.col("id").isin([r.id for r in found])).select("id").collect()}
        near = [r for r in found if r.id in known]
        if len(near) >= limit or len(found) < many:
            return near[:limit]
        many *= 8
    return scored.join(details.select("id"), "id", "left_semi").orderBy(F.desc("base"), "id").limit(limit).collect()


def hybrid_topk(vectors: DataFrame, details: DataFrame, vector: list[float], query: str, prefer: Preferences = Preferences(), k: int = K, expand: int = EXPAND) -> DataFrame:
    """The k best of the ``k * expand`` nearest rows, by rounded score, then base, then id.

    ``vectors`` (id, vector and small columns) are scored in the scan. The candidates, a bounded number of rows, are
    taken first, and their ids then pushed down to the scan of ``details``, so no other texts are read where the table
    is laid out by id. Both together have the columns that ``bonus`` reads. A row outside the candidates can't be
    promoted.
    """
    found = nearest_known(vectors, details, vector, k * expand)
    schema = base_scores(vectors, vector).schema
    rows = details.filter(F.col("id").isin([r.id for r in found])).join(F.broadcast(details.sparkSession.createDataFrame(found, schema)), "id")
    scored = rows.withColumn("score", F.round(bonus(query, prefer) + F.col("base"), 4)).withColumn("base_score", F.round("base", 4))
    return scored.orderBy(F.desc("score"), F.desc("base"), "id").limit(k)


def question_bonus() -> Column:
    """``bonus`` where each row has its question beside it: q_text, q_asset, q_modality and q_timestamp, null for no preference."""
    def when(c: Column, x: float) -> Column:
        return F.when(F.coalesce(c, F.lit(False)), F.lit(x)).otherwise(F.lit(0.0))

    video, pdf = F.col("modality") == "video", F.col("modality") == "pdf"
    kind = F.when(video & (F.col("content_type") == "transcript_context"), F.lit(TRANSCRIPT)).when(pdf & F.col("content_type").isin("heading", "title"), F.lit(HEADING)).otherwise(F.lit(0.0))
    named = (F.col("q_asset") != "") & contains_folded(F.col("asset_name"), F.col("q_asset"))
    liked = (F.col("q_modality") != "") & (F.col("modality") == F.col("q_modality"))
    return when(named, ASSET) + when(liked, MODALITY) + when(close_to(F.col("timestamp"), F.col("q_timestamp")), PLACE) + when(contains_folded(F.col("content_ref"), F.coalesce("q_text", F.lit(""))), CONTENT) + kind


def hybrid_many(vectors: DataFrame, details: DataFrame, questions: DataFrame, k: int = K, expand: int = EXPAND) -> DataFrame:
    """``hybrid_topk`` for a table of questions: question_id, place from 1, the columns of both tables, base, score and base_score.

    ``questions`` has question_id, vector, q_text, q_asset, q_modality and q_timestamp; question ids are distinct. The
    vectors are scored in blocks by ``knn.nearest`` and not shuffled. Candidates, a bounded number for each question,
    are broadcast to the scan of ``details`` while their number is under ``BROADCAST``.
    """
    limit = k * expand
    near = stored(knn.nearest(vectors, questions, limit + SPARE))
    ids = details.select(F.col("id").alias("known")).distinct()
    told = near.join(ids, F.col("id") == F.col("known"), "left").groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("known"))
    if not told.filter((F.col("n") == limit + SPARE) & (F.col("known") < limit)).isEmpty():
        near = stored(knn.nearest(vectors.join(details.select("id"), "id", "left_semi"), questions, limit))
    few = (lambda df: F.broadcast(df)) if near.count() <= BROADCAST else (lambda df: df)
    place = lambda *by: F.row_number().over(Window.partitionBy("question_id").orderBy(*by))
    met = details.join(few(near.drop("place")), "id").withColumn("place", place(F.desc("base"), "id")).filter(F.col("place") <= limit).drop("place")
    rest = [c for c in vectors.columns if c not in ("id", "vector")]
    if rest:
        met = met.join(few(vectors.select("id", *rest).join(few(near.select("id").distinct()), "id", "left_semi")), "id")
    scored = met.join(few(questions.drop("vector")), "question_id").withColumn("score", F.round(question_bonus() + F.col("base"), 4)).withColumn("base_score", F.round("base", 4))
    ranked = scored.withColumn("place", place(F.desc("score"), F.desc("base"), "id")).filter(F.col("place") <= k)
    return ranked.drop("q_text", "q_asset", "q_modality", "q_timestamp")


def evidence(hits: DataFrame) -> DataFrame:
    """Hits as evidence: a document's place is a page, a video's a time."""
    place = F.when(F.col("modality") == "video", F.col("timestamp"))
    page = F.when(F.col("modality") == "pdf", F.col("timestamp").cast("int"))
    meta = F.struct("asset_name", "modality", F.col("content_type").alias("type"), F.col("coordinates").alias("bbox"), place.alias("timestamp"), page.alias("page_label"))
    return hits.select("score", F.col("base_score").alias("base_vector_score"), F.col("content_ref").alias("content"), meta.alias("metadata"))


def accumulated(attempts: list[DataFrame], dedup: bool = False) -> DataFrame:
    """Evidence of all attempts, newest first by ``attempt`` and ``rank``; repeated rows stay unless ``dedup``."""
    out = None
    for i, hits in enumerate(attempts):
        rows = hits.withColumn("attempt", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    if dedup:  # of equal rows the newest and best placed one
        own = [c for c in out.columns if c not in ("attempt", "rank")]
        out = out.groupBy(*own).agg(F.max(F.struct("attempt", -F.col("rank"))).alias("at")).select(*own, (-F.col("at.col2")).alias("rank"), "at.attempt")
    return out.orderBy(F.desc("attempt"), "rank")


def parsed_question(refined: Column) -> dict[str, Column]:
    """Search words, k and preferences of a refined question (a JSON text), with defaults where keys are missing."""
    q = F.from_json(refined, "search_params struct<keywords:array<string>,top_k:int>, preferences struct<asset_name:string,modality:string,timestamp:double>, logic_intent struct<need_sandbox:boolean,reasoning_focus:string>")
    return {"query": F.coalesce(F.array_join(q["search_params"]["keywords"], " "), F.lit("")), "top_k": F.coalesce(q["search_params"]["top_k"], F.lit(K)), "preferences": q["preferences"], "need_sandbox": F.coalesce(q["logic_intent"]["need_sandbox"], F.lit(False))}
