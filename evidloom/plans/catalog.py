"""Queries by name and the SQL that gives the same rows.

The tables hold no media, so operators are bound to them by analogy: embeddings with their documents are the
collection; events are frames (type ``error``), segments (other types) and a signal over time; conversations are
sessions; orders are assets with a status.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidloom.functions import records, text, vectors
from evidloom.operators import align, backends, collection, flatten, ivf, keywords, knn, outline, registry, retrieval, sessions, slicer
from evidloom.plans import copies, shapes
from evidloom.sources.stored import stored
from evidloom.streaming import assets, keyed

#: The flagship's question.
QUESTION, PREFER = "the", retrieval.Preferences("src1", "video", 3.0)
KEYWORDS = ["ing", "keit"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdf = F.col("label") % 2 == 0
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(pdf, "pdf").otherwise("video").alias("modality"), F.when(pdf, "text").otherwise("transcript_context").alias("content_type"), F.col("embedding").alias("vector"))


def _details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("asset_name"), F.col("text").alias("content_ref"), (F.col("doc_id") % 30 + 1).cast("double").alias("timestamp"), F.lit("null").alias("coordinates"))


_COLL = """coll AS (SELECT vec_id AS id, source AS asset_name, CASE WHEN label % 2 = 0 THEN 'pdf' ELSE 'video' END AS modality,
  CASE WHEN label % 2 = 0 THEN 'text' ELSE 'transcript_context' END AS content_type, text AS content_ref, (doc_id % 30 + 1)::DOUBLE AS timestamp, embedding::DOUBLE[] AS vector
  FROM embeddings JOIN documents ON doc_id = vec_id)"""
_Q = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"


def _question_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The stand-in for an embedded question: one stored vector."""
    found = table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()
    return list(found[0]) if found else []


def hybrid_rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.hybrid_topk(_typed(spark, sf_dir), _details(spark, sf_dir), _question_vector(spark, sf_dir), QUESTION, PREFER)
    return hits.select("id", "asset_name", "modality", "score", "base_score")


def evidence_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.hybrid_topk(_typed(spark, sf_dir), _details(spark, sf_dir), _question_vector(spark, sf_dir), QUESTION, PREFER)
    return retrieval.evidence(hits).select("score", "base_vector_score", "content", "metadata.asset_name", "metadata.timestamp", "metadata.page_label")


_HITS = f"""WITH {_COLL}, {_Q}, near AS (SELECT coll.*, list_inner_product(vector, q) AS base FROM coll, q ORDER BY base DESC, id LIMIT 40),
scored AS (SELECT *, round((CASE WHEN contains(lower(asset_name), 'src1') THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN modality = 'video' THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN abs(timestamp - 3.0::DOUBLE) < 0.01::DOUBLE THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN contains(lower(content_ref), 'the') THEN 0.15::DOUBLE ELSE 0 END
  + CASE WHEN modality = 'video' AND content_type = 'transcript_context' THEN 0.05::DOUBLE ELSE 0 END) + base, 4) AS score, round(base, 4) AS base_score FROM near),
hits AS (SELECT * FROM scored ORDER BY score DESC, base DESC, id LIMIT 8)"""


def vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.base_scores(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")), _question_vector(spark, sf_dir)).select("vec_id", F.round("base", 6).alias("base"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for every stored vector whose id is divisible by 50, with its own document's place as what it prefers."""
    own = table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), F.col("vec_id") == F.col("doc_id"), "left")
    return own.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"), F.when(F.col("lang") == "de", "der").otherwise("the").alias("q_text"), F.col("source").alias("q_asset"), F.when(F.col("label") % 2 == 0, "pdf").otherwise("video").alias("q_modality"), (F.col("doc_id") % 30 + 1).cast("double").alias("q_timestamp"))


def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("vec_id").alias("question_id"))
    return knn.nearest(own, own.filter("question_id % 50 = 0"), 10).select("question_id", "place", "id", F.round("base", 6).alias("base"))


def question_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.hybrid_many(_typed(spark, sf_dir), _details(spark, sf_dir), _questions(spark, sf_dir))
    return hits.select("question_id", "place", "id", "asset_name", "modality", "score", "base_score")


_ASKED = f"""{_COLL}, asked AS (SELECT vec_id AS question_id, embedding::DOUBLE[] AS q, CASE WHEN lang = 'de' THEN 'der' ELSE 'the' END AS q_text, source AS q_asset, CASE WHEN label % 2 = 0 THEN 'pdf' ELSE 'video' END AS q_modality, doc_id % 30 + 1 AS q_at
  FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE vec_id % 50 = 0),
near AS (SELECT * FROM (SELECT *, list_inner_product(vector, q) AS base, row_number() OVER (PARTITION BY question_id ORDER BY list_inner_product(vector, q) DESC, id) AS r FROM coll, asked) WHERE r <= 40),
scored AS (SELECT *, round((CASE WHEN contains(lower(asset_name), lower(q_asset)) THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN modality = q_modality THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN abs(timestamp - q_at) < 0.01::DOUBLE THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN contains(lower(content_ref), q_text) THEN 0.15::DOUBLE ELSE 0 END
  + CASE WHEN modality = 'video' AND content_type = 'transcript_context' THEN 0.05::DOUBLE ELSE 0 END) + base, 4) AS score, round(base, 4) AS base_score FROM near)"""


def _seconds():
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) / 1e6


def _timed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("asset"), _seconds().alias("t"), "event_id", "event_type", "value")
    frames = own.filter("event_type = 'error'").select("asset", F.col("t").alias("ts"), F.col("event_id").alias("frame_id"))
    return frames, own.filter("event_type <> 'error'").select("asset", F.col("t").alias("start"), (F.col("t") + F.col("value") * 60.0).alias("end"), F.col("event_id").alias("segment_id"), F.col("event_type").alias("text"))


_TIMED = """f AS (SELECT user_id AS asset, epoch_us(ts) / 1e6::DOUBLE AS ts, event_id AS frame_id FROM events WHERE event_type = 'error'),
s AS (SELECT user_id AS asset, epoch_us(ts) / 1e6::DOUBLE AS start, epoch_us(ts) / 1e6::DOUBLE + value * 60.0::DOUBLE AS stop, event_id AS segment_id, event_type AS text FROM events WHERE event_type <> 'error' AND value >= 0)"""
_MEET = "f.asset = s.asset AND s.stop >= f.ts - 5.0::DOUBLE AND s.start <= f.ts + 15.0::DOUBLE"


def overlap_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(*_timed(spark, sf_dir)).select("asset", "frame_id", "content", "need_vision")


def overlap_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.overlap_pairs(*_timed(spark, sf_dir)).select("asset", "frame_id", "segment_id")


def overlap_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, segments = _timed(spark, sf_dir)
    return align.theta_pairs(frames, segments.filter("start <= end")).select("asset", "frame_id", "segment_id")


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events")
    first = own.groupBy("user_id").agg(F.min("ts").alias("begin"))
    since = F.timestamp_diff("MICROSECOND", F.col("begin").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) / 1e6
    return own.join(first, "user_id").select(F.col("user_id").alias("asset"), since.alias("ts"), F.col("event_id").alias("frame_id"), F.col("value").alias("signal"))


def slicer_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicer.greedy_throttle(_signal(spark, sf_dir))


def uniform_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicer.uniform(_signal(spark, sf_dir), 5).select("asset", "frame_id")


def key_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicer.key_frames(_signal(spark, sf_dir)).select("asset", "frame_id")


_SIGNAL = """sig AS (SELECT user_id AS asset, event_id AS frame_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6::DOUBLE AS t, value FROM events),
placed AS (SELECT *, abs(value - lag(value) OVER w) AS change, row_number() OVER w AS place FROM sig WINDOW w AS (PARTITION BY asset ORDER BY t, frame_id)),
cand AS (SELECT asset, frame_id, t, row_number() OVER (PARTITION BY asset ORDER BY t, frame_id) AS i FROM placed WHERE place > 1 AND change > 0.03::DOUBLE),
kept AS (SELECT asset, min(i) AS i, arg_min(t, i) AS t FROM cand WHERE t + 10 > 10 GROUP BY asset
  UNION ALL SELECT c.asset, min(c.i), arg_min(c.t, c.i) FROM kept k JOIN cand c ON c.asset = k.asset AND c.i > k.i AND c.t - k.t > 10 GROUP BY c.asset),
slices AS (SELECT asset, frame_id, t FROM placed WHERE place = 1 UNION ALL SELECT c.asset, c.frame_id, c.t FROM kept JOIN cand c USING (asset, i))"""
_UNIFORM = """goals AS (SELECT asset, count(*) AS total, {goal} AS goal FROM sig GROUP BY asset),
sample AS (SELECT asset, frame_id, t, goal FROM placed JOIN goals USING (asset) WHERE (place - 1) % greatest(total // goal, 1) = 0 AND place - 1 < greatest(total // goal, 1) * goal)"""


def block_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.lines_as_blocks(table(spark, sf_dir, "documents"))


def unpivot_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("a"), "label").alias("asset"), "vec_id", "label", "embedding")
    none = F.lit(None).cast("array<float>")
    video = own.filter("label % 2 = 1").select("asset", (F.col("vec_id") / 2).alias("timestamp"), text.frame_name(F.col("vec_id") / 2).alias("frame_name"), F.when(F.col("vec_id") % 5 != 0, F.col("embedding")).otherwise(none).alias("img_vector"), F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).otherwise(none).alias("text_vector"), F.concat(F.lit("said "), "vec_id").alias("content"))
    pages = own.filter("label % 2 = 0").select("asset", F.concat("vec_id", F.lit(".jpg")).alias("name"), (F.col("vec_id") % 40).cast("int").alias("page_idx"), F.array(F.lit(1.5), F.lit(2.0)).alias("bbox"), F.concat(F.lit("text "), "vec_id").alias("text_slice"), F.col("embedding").alias("vector"))
    rows = collection.document_rows(pages, pages).unionByName(collection.video_rows(video))
    return rows.select("asset_name", "modality", "content_type", "content_ref", "timestamp", F.size("vector").cast("bigint").alias("dim"))


def last_six_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.context(table(spark, sf_dir, "conversations"))


def session_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.names(table(spark, sf_dir, "conversations"))


def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.counts(table(spark, sf_dir, "conversations"))


def last_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.last_flag(table(spark, sf_dir, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn", "is_last")


def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.changed(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


def global_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.global_state(table(spark, sf_dir, "orders"), uploading="P", status="o_orderstatus")


def structure_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.structure_state(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("asset_id"), F.when(F.col("o_orderstatus") == "F", "Ready").otherwise("Raw").alias("status")))


def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 7)


def evidence_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("asset_name"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asset_id"), F.col("c_name").alias("asset_processed_path"))
    return registry.with_assets(evidence, known)


def merge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    server = table(spark, sf_dir, "orders").filter("o_totalprice > 100000").select(F.col("o_orderkey").alias("id"), F.lower("o_orderstatus").alias("status"))
    return registry.merged(own, server, "id")


def last_wins_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.last_by_key(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def anchor_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 2 == 0, "video").otherwise("pdf")
    return table(spark, sf_dir, "events").select("event_id", text.anchor(kind, F.abs("value")).alias("anchor"))


def bbox_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.concat(F.lit("["), F.concat_ws(", ", F.col("event_id") % 100, F.lit(20), F.lit(30.5), F.lit(40)), F.lit("]"))
    scaled = text.scaled_box(box, 800.0)
    return table(spark, sf_dir, "events").select("event_id", *(F.round(scaled[i], 6).alias(f"x{i}") for i in range(4)))


def exclude_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(text.without_any(F.col("line"), KEYWORDS))


def keyword_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without any of the hundreds of longer words that the benchmark's passages have; the list is a table."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"[^\p{L}]+")).alias("keyword")).filter("length(keyword) >= 8")
    return keywords.without_keywords(lines, "line", words)


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


def marker_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", records.between(F.col("html"), "<title>", "</title>").alias("title"))


def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.l2_normalized(F.col("embedding"))).alias("position", "x"))
    return own.select("vec_id", "position", F.round("x", 6).alias("x"))


def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.mean_pooled(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", "position", F.round("mean", 6).alias("mean"))


def frame_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    flipped = F.transform("embedding", lambda x: -x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.mean_abs_difference(F.col("embedding"), flipped), 9).alias("change"))


def sandbox_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("2 * ("), F.col("event_id") % 1000, F.lit(" + 3) / 4")).alias("expression"))
    return backends.calculated(own, "expression").select("event_id", "result")


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select(F.to_date("ts").cast("timestamp_ntz").alias("ts"), "event_type")
    return own.groupBy(F.col("ts").cast("date").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def next_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "Raw").when(F.col("o_orderstatus") == "F", "Ingesting").otherwise("Ready")
    return table(spark, sf_dir, "orders").select("o_orderkey", assets.next_state(status, F.col("o_totalprice") > 200000).alias("status"))


#: The events of this binding lie hours apart, so its limits are twelve times those of real steps.
SLOW = {s: {k: 12 * v for k, v in by.items()} for s, by in keyed.LIMITS.items()}


def asset_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as assets whose events are steps that are done, or failed for errors; a limit passes where events are far apart."""
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("asset_id"), "event_id", F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("event"), F.when(F.col("user_id") % 2 == 0, "pdf").otherwise("video").alias("asset_type"), F.col("ts").alias("at"))
    since = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("at").cast("timestamp_ntz"))
    return keyed.asset_history(own, limits=SLOW).select("asset_id", "status", since.alias("at_us"), "reason")


_HISTORY = """e AS (SELECT user_id AS asset_id, event_id, event_type = 'error' AS failed, epoch_us(ts) AS t, CASE WHEN user_id % 2 = 0 THEN 1200 ELSE 1800 END AS own FROM events),
done AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY t, event_id) AS n FROM e WHERE NOT failed),
limits AS (SELECT *, t + 12000000::BIGINT * CASE n WHEN 2 THEN own WHEN 3 THEN 3600 WHEN 4 THEN 3600 WHEN 5 THEN 3600 END AS deadline FROM done WHERE n <= 6),
bad AS (SELECT asset_id, min((t, event_id)) AS b FROM e WHERE failed GROUP BY asset_id),
steps AS (SELECT l.*, lag(deadline) OVER (PARTITION BY l.asset_id ORDER BY n) AS before, b FROM limits l LEFT JOIN bad USING (asset_id)),
met AS (SELECT *, bool_and(coalesce(t <= before, true) AND coalesce((t, event_id) < b, true)) OVER (PARTITION BY asset_id ORDER BY n) AS ok FROM steps),
ends AS (SELECT a.asset_id, a.latest, bad.b[1] AS b, coalesce(max(n) FILTER (ok), 0) AS n FROM (SELECT asset_id, max(t) AS latest FROM e GROUP BY asset_id) a LEFT JOIN met USING (asset_id) LEFT JOIN bad USING (asset_id) GROUP BY ALL),
last_ AS (SELECT ends.asset_id, latest, ends.b, ends.n, m.deadline FROM ends LEFT JOIN met m ON m.asset_id = ends.asset_id AND m.n = ends.n)"""


def worker_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.concat(F.lit("started\nstill at it\n"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"v": '), "event_id", F.lit("}"))).otherwise(F.lit("gave up")), F.lit("\n"))
    own = table(spark, sf_dir, "events").select("event_id", records.last_line_record(out, "v bigint").alias("r"))
    return own.select("event_id", "r.status", F.col("r.data.v").alias("v"))


def piped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.when(F.col("event_id") % 4 == 0, "FAILED").otherwise("SUCCESS"), F.lit("|ID:"), "event_id", F.lit("|KIND:"), "event_type", F.lit(":lost|bare"))
    own = table(spark, sf_dir, "events").select("event_id", records.piped(line).alias("m"))
    return own.select("event_id", F.col("m")["ID"].alias("id"), F.col("m")["KIND"].alias("kind"))


def stream_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit('data: {"choices": [{"delta": {"content": "'), F.col("role"), F.lit('"}}]}'))
    line = F.when(F.col("turn") == 3, "data: [DONE]").when(F.col("turn") == 1, ": ping").otherwise(said)
    return records.deltas(table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line")), "conv_id", "turn", "line")


def image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings")
    pages = own.select(F.concat(F.lit("a"), "label").alias("asset"), F.concat("vec_id", F.lit(".jpg")).alias("name"), F.lit(0).alias("page_idx"), F.array(F.lit(1.0)).alias("bbox"), F.lit("").alias("text_slice"), F.col("embedding").alias("vector"))
    urls = own.filter("vec_id % 2 = 0").select(F.concat(F.lit("a"), "label").alias("asset"), F.concat("vec_id", F.lit(".jpg")).alias("name"), F.concat(F.lit("store/"), "vec_id").alias("url"))
    return collection.document_rows(pages, pages.limit(0), urls).select("asset_name", "content_ref")


def evidence_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings")
    evidence = own.select("vec_id", F.concat(F.lit("a"), "label").alias("asset_name"), (F.col("vec_id") / 4).alias("timestamp"))
    frames = own.filter("vec_id % 3 = 0").select(F.concat(F.lit("a"), "label").alias("asset_name"), text.frame_name(F.col("vec_id") / 4).alias("name"), F.concat(F.lit("frames/"), "vec_id").alias("path"))
    return registry.with_frames(evidence, frames).select("vec_id", "name", "path")


def strategy_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.instructions(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("strategy")), {"error": "look closely", "scene_description": "describe"}).select("event_id", "instruction")


def accumulated_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two attempts that share rows, the newest first, repeated ones once; ``place`` tells the order."""
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    place = (F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")) - 1).alias("rank")
    tries = [own.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(n) for n in (5, 3)]
    ranked = [t.select("o_orderkey", "o_orderpriority", place) for t in tries]
    return retrieval.accumulated(ranked, dedup=True).select("o_orderkey", "o_orderpriority", "attempt", "rank")


def first_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("items"))
    return own.select("conv_id", F.array_join(F.transform(sessions.first_items(F.col("items")), lambda x: x["role"]), ",").alias("roles"))


def waiting_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("asset_id"), F.when(F.col("o_orderstatus") == "O", "Raw").otherwise("Ready").alias("status"), F.col("o_orderdate").cast("string").alias("created_at"))
    return registry.queued(own)


def _asset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        F.concat(key, F.when(F.col("o_orderkey") % 2 == 0, ".pdf").otherwise(".mp4")).alias("asset_id"),
        F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, "video").alias("asset_type"),
        F.when(F.col("o_orderstatus") == "F", "Ready").when(F.col("o_orderstatus") == "P", "").alias("status"),
        F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate").cast("string")).alias("created_at"),
        F.concat(F.lit("/data/storage/raw/storage-"), key).alias("asset_raw_path"), F.concat(F.lit("done/"), key).alias("asset_processed_path"),
    )


def asset_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.normalised(_asset_rows(spark, sf_dir), F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"))


def preview_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.previews(_asset_rows(spark, sf_dir)).select("asset_id", "raw_path")


def upload_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    endings = F.element_at(F.array(*map(F.lit, (".PDF", ".mp4", ".mkv", ".mov", ".txt", ""))), (F.col("event_id") % 6 + 1).cast("int"))
    own = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("file.v"), "event_id", endings).alias("name"))
    return own.select("event_id", text.asset_type(F.col("name")).alias("asset_type")).filter("asset_type is not null")


def public_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.create_map(F.lit("x"), F.col("event_id").cast("string"), F.concat(F.when(F.col("event_id") % 2 == 0, "__").otherwise("y"), "event_type"), F.lit("1"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(backends.public_fields(made))), ",").alias("names"))


def visual_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda df: df.select("event_id", F.concat("event_id", F.element_at(F.array(*map(F.lit, (".jpg", ".mp4", ".doc"))), (F.col("event_id") % 3 + 1).cast("int"))).alias("path"))
    own = table(spark, sf_dir, "events")
    return registry.present(named(own), named(own.filter("event_type <> 'error'")).select("path")).select("event_id", "kind")


def conversation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("history"))
    asked = own.select("conv_id", F.explode(sessions.conversation_prompt(F.col("history"), F.lit("and now?"))).alias("m"))
    return asked.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("m.role") == "user") & (F.col("m.text") == "and now?")).alias("n_new"))


def admitted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("at"), "role")
    return sessions.admitted(own, own.filter("chat_id % 5 = 0").select("chat_id").distinct())


def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("Idle", "Preparing", "Researching", "Evaluating", "Strengthening", "Finalizing")
    status = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 6 + 1).cast("int"))
    state = sessions.next_state(status, F.col("event_id") % 4 == 0, F.col("event_id") % 3, F.col("event_id") % 11 == 0)
    return table(spark, sf_dir, "events").select("event_id", state.alias("status"))


def outline_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("asset"), F.col("turn").cast("double").alias("start"), F.col("turn").alias("segment_id"), "text")
    return outline.transcript_context(segments)


def solved_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("2*y - "), F.col("event_id") * 2, F.lit(" = 0")).alias("expression"), F.when(F.col("event_id") % 3 == 0, "guess").otherwise("solve").alias("mode"), F.lit("y").alias("symbol"))
    return backends.reckoned(own).select("event_id", F.col("result.values")["0"].alias("root"), F.col("result.error").alias("error"))


def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("docs"), F.max(F.when(F.col("role") == "system", F.col("role"))).alias("system"))
    template = 'Q {{ conv_id }}:{% for d in docs %} {{ loop.index }}={{ d.role }}{% endfor %}{% if system %} (ruled){% else %} (free){% endif %} {{ system if system else "none" }}'
    return own.select("conv_id", backends.rendered(template, conv_id=F.col("conv_id"), docs=F.col("docs"), system=F.col("system")).alias("prompt"))


def clock_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", text.clock(at).alias("clock"), text.log_stamp(at).alias("stamp"))


def video_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(slicer.duration(F.col("event_id"), F.col("event_id") % 30), 6).alias("seconds"))


def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With all cells probed the index gives the exact answer; a test measures the recall with fewer."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    centroids, rows = ivf.indexed(own, cells=16)
    return ivf.ivf_topk(rows, centroids, _question_vector(spark, sf_dir), 10, probes=16).select("id", F.round("base", 6).alias("base"))


def index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the coded index: all codes are read, and every vector is scored that its code doesn't rule out."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    codes, rows = ivf.coded(own, cells=16)
    return ivf.coded_topk(stored(rows), codes, _question_vector(spark, sf_dir), 10, rescored=100, exact=True).select("id", F.round("base", 6).alias("base"))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    hybrid_rerank_topk, evidence_structs, vector_scores, overlap_align, overlap_binned, overlap_theta, slicer_keep, uniform_fallback, key_frames,
    block_flatten, unpivot_collection, last_six_context, session_names, session_counts, last_message, status_changes, global_state, structure_state,
    registry_lookup, evidence_assets, merge_rows, last_wins_by_key, anchor_format, bbox_scale, exclude_keywords, json_props, marker_capture, l2_normalize,
    mean_pool, frame_change, sandbox_eval, daily_counts, next_states,
    worker_records, piped_records, stream_deltas, image_urls, evidence_frames, strategy_instructions, accumulated_hits, first_two, waiting_queue,
    asset_records, preview_paths, upload_types, public_keys, visual_files, conversation_prompts, admitted_requests, session_states, outline_contexts,
    solved_formulas, rendered_prompts, clock_times, video_durations, ivf_topk, knn_join, question_hits, asset_histories, keyword_lines, index_topk,
)

_STRIP = r"regexp_replace(line, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
_LINES = "SELECT doc_id, generate_subscripts(l, 1) - 1 AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
ORACLE: dict[str, str] = {
    "hybrid_rerank_topk": f"{_HITS} SELECT id, asset_name, modality, score, base_score FROM hits",
    "evidence_structs": f"{_HITS} SELECT score, base_score AS base_vector_score, content_ref AS content, asset_name, CASE WHEN modality = 'video' THEN timestamp END AS timestamp, CASE WHEN modality = 'pdf' THEN timestamp::INT END AS page_label FROM hits",
    "vector_scores": f"WITH {_Q} SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], q), 6) AS base FROM embeddings, q",
    "knn_join": "SELECT question_id, place::INT AS place, id, round(base, 6) AS base FROM (SELECT q.vec_id AS question_id, e.vec_id AS id, list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS base, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS place FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) WHERE place <= 10",
    "question_hits": f"WITH {_ASKED} SELECT question_id, place::INT AS place, id, asset_name, modality, score, base_score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, base DESC, id) AS place FROM scored) WHERE place <= 8",
    "overlap_align": f"WITH {_TIMED} SELECT f.asset, frame_id, coalesce(string_agg(text, ' ' ORDER BY start, segment_id), '') AS content, length(coalesce(string_agg(text, ' ' ORDER BY start, segment_id), '')) < 15 AS need_vision FROM f LEFT JOIN s ON {_MEET} GROUP BY f.asset, frame_id",
    "overlap_binned": f"WITH {_TIMED} SELECT f.asset, frame_id, segment_id FROM f JOIN s ON {_MEET}",
    "overlap_theta": f"WITH {_TIMED} SELECT f.asset, frame_id, segment_id FROM f JOIN s ON {_MEET}",
    "slicer_keep": f"WITH RECURSIVE {_SIGNAL} SELECT asset, t AS ts, frame_id FROM slices",
    "uniform_fallback": f"WITH RECURSIVE {_SIGNAL}, {_UNIFORM.format(goal='5')} SELECT asset, frame_id FROM sample",
    "key_frames": f"WITH RECURSIVE {_SIGNAL}, {_UNIFORM.format(goal='greatest(floor(max(t) / 15), 5)::BIGINT')}, n AS (SELECT asset, count(*) AS kept FROM slices GROUP BY asset) SELECT asset, frame_id FROM slices UNION SELECT asset, frame_id FROM sample LEFT JOIN n USING (asset) WHERE coalesce(kept, 0) < goal",
    "block_flatten": f"SELECT doc_id, n::INT AS block_idx, {_STRIP} AS text, substring({_STRIP}, 1, 50) AS text_slice FROM ({_LINES}) WHERE length({_STRIP}) >= 5",
    "unpivot_collection": """WITH o AS (SELECT *, 'a' || label AS asset_name, len(embedding)::BIGINT AS dim FROM embeddings)
SELECT asset_name, 'pdf' AS modality, 'image' AS content_type, vec_id || '.jpg' AS content_ref, (vec_id % 40 + 1)::DOUBLE AS timestamp, dim FROM o WHERE label % 2 = 0
UNION ALL SELECT asset_name, 'pdf', 'text', 'text ' || vec_id, (vec_id % 40 + 1)::DOUBLE, dim FROM o WHERE label % 2 = 0
UNION ALL SELECT asset_name, 'video', 'image_frame', printf('time_%.2f.jpg', vec_id / 2), vec_id / 2, dim FROM o WHERE label % 2 = 1 AND vec_id % 5 <> 0
UNION ALL SELECT asset_name, 'video', 'transcript_context', 'said ' || vec_id, vec_id / 2, dim FROM o WHERE label % 2 = 1 AND vec_id % 3 <> 0""",
    "last_six_context": "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY r DESC) AS history, count(*) AS n_messages FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS r FROM conversations) WHERE r <= 6 GROUP BY conv_id",
    "session_names": "SELECT conv_id, 'Chat-' || substring(arg_min(text, turn), 1, 12) AS chat_name FROM conversations GROUP BY conv_id",
    "session_counts": "SELECT conv_id, count(*) AS messages_count, 0::BIGINT AS evidence_count FROM conversations GROUP BY conv_id",
    "last_message": "SELECT conv_id, turn, lead(1) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS is_last FROM conversations",
    "status_changes": "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR before IS DISTINCT FROM event_type",
    "global_state": "SELECT count(*) AS n_assets, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'Uploading' ELSE 'Waiting' END AS state FROM orders",
    "structure_state": "SELECT o_orderkey AS asset_id, CASE WHEN o_orderstatus = 'F' THEN 'ready' ELSE 'processing' END AS structure FROM orders",
    "registry_lookup": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 7",
    "evidence_assets": "SELECT o_custkey AS asset_name, o_orderkey, c_name AS asset_processed_path FROM orders JOIN customer ON c_custkey = o_custkey",
    "merge_rows": "SELECT o_orderkey AS id, CASE WHEN o_totalprice > 100000 THEN lower(o_orderstatus) ELSE o_orderstatus END AS status FROM orders",
    "last_wins_by_key": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "anchor_format": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (floor(abs(value))::BIGINT // 60) || ':' || lpad((floor(abs(value))::BIGINT % 60)::VARCHAR, 2, '0') ELSE 'P.' || trunc(abs(value))::INT END AS anchor FROM events",
    "bbox_scale": "SELECT event_id, round((event_id % 100)::DOUBLE * (800.0::DOUBLE / 595.28::DOUBLE), 6) AS x0, round(20::DOUBLE * (800.0::DOUBLE / 595.28::DOUBLE), 6) AS x1, round(30.5::DOUBLE * (800.0::DOUBLE / 595.28::DOUBLE), 6) AS x2, round(40::DOUBLE * (800.0::DOUBLE / 595.28::DOUBLE), 6) AS x3 FROM events",
    "exclude_keywords": f"SELECT doc_id, n::INT AS line_no, line FROM ({_LINES}) WHERE " + " AND ".join(f"NOT contains(line, '{k}')" for k in KEYWORDS),
    "keyword_lines": f"WITH words AS MATERIALIZED (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(text, '[^\\p{{L}}]+')) AS w FROM benchmark) WHERE length(w) >= 8), all_ AS (SELECT list(w) AS ws FROM words) SELECT doc_id, n::INT AS line_no, line FROM ({_LINES}), all_ WHERE len(list_filter(ws, lambda w: contains(line, w))) = 0",
    "json_props": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "marker_capture": "SELECT page_id, CASE WHEN contains(html, '<title>') AND contains(substring(html, strpos(html, '<title>') + 7), '</title>') THEN string_split(substring(html, strpos(html, '<title>') + 7), '</title>')[1] END AS title FROM pages",
    "l2_normalize": "SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS position, round(unnest(embedding)::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS x FROM embeddings",
    "mean_pool": "SELECT label, position::INT AS position, round(avg(x), 6) AS mean FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS position, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL",
    "frame_change": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(2 * x::DOUBLE))) / len(embedding) / 255.0::DOUBLE, 9) AS change FROM embeddings",
    "sandbox_eval": "SELECT event_id, 2 * (event_id % 1000 + 3)::DOUBLE / 4 AS result FROM events",
    "daily_counts": "SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "next_states": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 AND o_orderstatus IN ('O', 'F') THEN 'Failed' WHEN o_orderstatus = 'O' THEN 'recognizing' ELSE 'Ready' END AS status FROM orders",
    "asset_histories": f"""WITH {_HISTORY} SELECT asset_id, ['Raw', 'recognizing', 'Cliping', 'Structuring', 'Ingesting', 'Ready'][n] AS status, t AS at_us, 'done' AS reason FROM met WHERE ok
UNION ALL SELECT asset_id, 'Failed', CASE WHEN b <= deadline OR b IS NOT NULL AND deadline IS NULL THEN b ELSE deadline END, CASE WHEN b <= deadline OR b IS NOT NULL AND deadline IS NULL THEN 'failed' ELSE 'timeout' END
FROM last_ WHERE n < 6 AND (b <= deadline OR b IS NOT NULL AND deadline IS NULL OR deadline < latest)""",
    "worker_records": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'success' ELSE 'partial_success' END AS status, CASE WHEN event_id % 3 = 0 THEN event_id END AS v FROM events",
    "piped_records": "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_id::VARCHAR END AS id, CASE WHEN event_id % 4 <> 0 THEN event_type END AS kind FROM events",
    "stream_deltas": "SELECT conv_id, turn, role AS delta FROM conversations c WHERE turn NOT IN (1, 3) AND NOT EXISTS (SELECT 1 FROM conversations e WHERE e.conv_id = c.conv_id AND e.turn = 3 AND c.turn > 3) AND role IS NOT NULL",
    "image_urls": "SELECT 'a' || label AS asset_name, CASE WHEN vec_id % 2 = 0 THEN 'store/' || vec_id ELSE vec_id || '.jpg' END AS content_ref FROM embeddings",
    "evidence_frames": "SELECT vec_id, printf('time_%.2f.jpg', vec_id / 4) AS name, CASE WHEN vec_id % 3 = 0 THEN 'frames/' || vec_id END AS path FROM embeddings",
    "strategy_instructions": "SELECT event_id, CASE WHEN event_type = 'error' THEN 'look closely' ELSE 'describe' END AS instruction FROM events",
    "accumulated_hits": "SELECT o_orderkey, o_orderpriority, CASE WHEN r <= 3 THEN 1 ELSE 0 END AS attempt, (r - 1)::INT AS rank FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 5",
    "first_two": "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS r FROM conversations) WHERE r <= 2 GROUP BY conv_id",
    "waiting_queue": "SELECT o_orderkey AS asset_id, o_orderdate::VARCHAR AS created_at FROM orders WHERE o_orderstatus = 'O'",
    "asset_records": """WITH a AS (SELECT *, o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.pdf' ELSE '.mp4' END AS id, CASE WHEN o_orderstatus = 'F' THEN 'Ready' ELSE 'Raw' END AS status FROM orders)
SELECT id, id AS name, CASE WHEN o_orderkey % 3 = 1 OR o_orderkey % 2 = 1 THEN 'video' ELSE 'pdf' END AS type, status, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate::VARCHAR ELSE '2024-01-02T03:04:05.000000' END AS created_at,
  'done/' || o_orderkey AS asset_processed_path, CASE WHEN status = 'Ready' THEN 100 ELSE 0 END AS progress FROM a""",
    "preview_paths": "SELECT o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.pdf' ELSE '.mp4' END AS asset_id, '/data//raw/-' || o_orderkey AS raw_path FROM orders",
    "upload_types": "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'pdf' ELSE 'video' END AS asset_type FROM events WHERE event_id % 6 < 4",
    "public_keys": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'x' WHEN 'y' || event_type < 'x' THEN 'y' || event_type || ',x' ELSE 'x,y' || event_type END AS names FROM events",
    "visual_files": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'image' ELSE 'video' END AS kind FROM events WHERE event_type <> 'error' AND event_id % 3 < 2",
    "conversation_prompts": "SELECT conv_id, count(*) + 1 AS n, 1 + count(*) FILTER (role = 'user' AND text = 'and now?') AS n_new FROM conversations GROUP BY conv_id",
    "admitted_requests": "SELECT conv_id AS chat_id, turn AS \"at\", role FROM conversations WHERE conv_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1",
    "session_states": "SELECT event_id, CASE WHEN event_id % 11 = 0 AND event_id % 6 <> 0 THEN 'FAILED' ELSE CASE event_id % 6 WHEN 0 THEN 'Preparing' WHEN 1 THEN 'Researching' WHEN 2 THEN 'Evaluating' WHEN 3 THEN CASE WHEN event_id % 4 = 0 OR event_id % 3 >= 2 THEN 'Strengthening' ELSE 'Researching' END WHEN 4 THEN 'Finalizing' ELSE 'Idle' END END AS status FROM events",
    "outline_contexts": "SELECT conv_id AS asset, substring(string_agg('[' || turn::DOUBLE || 's]: ' || text, chr(10) ORDER BY turn), 1, 50000) AS context FROM conversations GROUP BY conv_id",
    "solved_formulas": "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id::VARCHAR END AS root, CASE WHEN event_id % 3 = 0 THEN 'not understood: guess' END AS error FROM events",
    "rendered_prompts": "SELECT conv_id, 'Q ' || conv_id || ':' || string_agg(' ' || r || '=' || role, '' ORDER BY r) || CASE WHEN bool_or(role = 'system') THEN ' (ruled) system' ELSE ' (free) none' END AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS r FROM conversations) GROUP BY conv_id",
    "clock_times": "SELECT event_id, strftime(ts, '%H:%M') AS clock, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events",
    "video_durations": "SELECT event_id, CASE WHEN event_id % 30 > 0 THEN round(event_id / (event_id % 30), 6) ELSE 0 END::DOUBLE AS seconds FROM events",
    "ivf_topk": f"WITH {_Q} SELECT vec_id AS id, round(list_inner_product(embedding::DOUBLE[], q), 6) AS base FROM embeddings, q ORDER BY list_inner_product(embedding::DOUBLE[], q) DESC, vec_id LIMIT 10",
}


ORACLE["index_topk"] = ORACLE["ivf_topk"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*QUERIES, *copies.QUERIES, *shapes.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return ORACLE | copies.ORACLE | shapes.ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_rerank_topk(spark, sf_dir)
