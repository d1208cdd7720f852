"""The queries, and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import exif as X
from sievework.functions import images as I
from sievework.functions import scalars as S
from sievework.functions import text_time as T
from sievework.functions import vectors as V
from sievework.operators import density, features, gates, graphs, ordered, ranking, selection, similarity
from sievework.plans.bridge import PHOTOS, photos, table
from sievework.sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Rows of embeddings that serve as label vectors.
PROMPTS = range(11)
SUBJECTS = {0: 1.0, 1: 0.6, 2: 0.3}
HOME = (10.0, 20.0)
SCALARS = "id, path, file_hash, file_size, timestamp, lat, lon, has_gps, camera_model, blur_score, exposure_score, resolution, detail_stddev, flesh_fraction, face_count, person_id, aesthetic_score, smile_score, cluster_id, is_private, quality_pass"


def query(sql: str | None = None, cte: str = ""):
    """Registers f(photos, spark, sf_dir); sql selects from the DuckDB view of the same table."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(photos(spark, sf_dir), spark, sf_dir)
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {PHOTOS}{', ' + cte if cte else ''} {sql}"
        return f

    return put


@lru_cache(maxsize=8)
def _prompts(spark: SparkSession, sf_dir: str) -> list[list[float]]:
    rows = table(spark, sf_dir, "embeddings").filter(F.col("vec_id").isin(*PROMPTS)).orderBy("vec_id").collect()
    return [[float(x) for x in r.embedding] for r in rows]


def _dot(i: int, v: str = "clip_emb") -> str:
    return f"list_dot_product({v}::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {i}))"


R6 = lambda c: F.round(c, 6)

# -- scans, filters, sources ------------------------------------------------------------------------------------------


@query(f"SELECT {SCALARS} FROM photos")
def photos_scan(p, spark, sf):
    return p.select(*SCALARS.split(", "))


@query("SELECT id, path FROM photos WHERE is_private = 0 AND NOT EXISTS (SELECT 1 FROM photos q WHERE q.file_hash = photos.file_hash AND (q.blur_score, q.file_size, -q.id) > (photos.blur_score, photos.file_size, -photos.id))")
def photos_kept(p, spark, sf):
    w = Window.partitionBy("file_hash").orderBy(F.desc("blur_score"), F.desc("file_size"), "id")
    return p.select("id", "path", "file_hash", "blur_score", "file_size", "is_private").withColumn("r", F.row_number().over(w)).filter("r = 1 and is_private = 0").select("id", "path")


@query("SELECT id, is_private FROM photos WHERE is_private = 0")
def photos_non_private(p, spark, sf):
    return p.filter("is_private = 0").select("id", "is_private")


@query("SELECT id, face_count FROM photos WHERE face_count >= 2")
def faces_at_least(p, spark, sf):
    return p.filter("face_count >= 2").select("id", "face_count")


@query("SELECT id, path FROM photos WHERE clip_emb IS NOT NULL")
def with_embedding(p, spark, sf):
    return p.filter("clip_emb is not null").select("id", "path")


@query("SELECT doc_id, sha256(text) AS sha, md5(text) AS md5, CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 1 THEN true ELSE false END AS valid FROM documents")
def content_hash(p, spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"))
    cached = F.when(F.expr("doc_id % 3 = 0"), F.col("sha")).when(F.expr("doc_id % 3 = 1"), F.col("md5")).otherwise("")
    return d.select("doc_id", "sha", "md5", S.hash_matches(cached, F.col("sha"), F.col("md5")).alias("valid"))


@query("SELECT id, file_hash FROM (SELECT id, file_hash, row_number() OVER (PARTITION BY file_hash ORDER BY blur_score DESC, file_size DESC, id) AS r FROM photos) WHERE r > 1")
def exact_duplicates(p, spark, sf):
    w = Window.partitionBy("file_hash").orderBy(F.desc("blur_score"), F.desc("file_size"), "id")
    return p.withColumn("r", F.row_number().over(w)).filter("r > 1").select("id", "file_hash")


@query("SELECT path FROM photos WHERE id % 2 = 1 OR id % 10 = 0")
def incremental_new_rows(p, spark, sf):
    cached = p.filter("id % 2 = 0").select("path", F.when(F.expr("id % 10 = 0"), F.lit("0" * 64)).otherwise(F.col("file_hash")).alias("file_hash"))
    return store.new_rows(p.select("path", "file_hash", F.lit("").alias("file_md5")), cached).select("path")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 0.5 ELSE aesthetic_score END AS aesthetic_score, CASE WHEN id % 2 = 0 THEN smile_score END AS smile_score FROM photos WHERE id % 2 = 0 OR id % 3 = 0")
def upsert_merge(p, spark, sf):
    old = p.filter("id % 2 = 0").select("id", "aesthetic_score", "smile_score")
    return store.upsert(old, p.filter("id % 3 = 0").select("id", F.lit(0.5).alias("aesthetic_score")), "id")


@query("SELECT path FROM photos WHERE clip_emb IS NOT NULL AND id % 2 = 1")
def vector_sync_anti(p, spark, sf):
    return store.missing_vectors(p, p.filter("id % 2 = 0").select("path"), 64).select("path")


# -- vectors ----------------------------------------------------------------------------------------------------------


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norm_guard(p, spark, sf):
    e = table(spark, sf, "embeddings").filter(V.usable(F.col("embedding")))
    return e.select("vec_id", R6(V.norm(F.col("embedding"))).alias("norm"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS cosine FROM embeddings")
def cosine_to_anchor(p, spark, sf):
    anchor = V.literal(_prompts(spark, sf)[0])
    return table(spark, sf, "embeddings").select("vec_id", R6(V.cosine(F.col("embedding"), anchor)).alias("cosine"))


@query("""SELECT query, id, round(s, 6) AS cosine FROM (
  SELECT q.vec_id AS query, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) AS r
  FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id) WHERE r <= 10""")
def knn_top10(p, spark, sf):
    e = table(spark, sf, "embeddings")
    return similarity.nearest(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", 10).select("query", "id", R6("s").alias("cosine"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4")
def cosine_pairs_ge(p, spark, sf):
    return similarity.cosine_pairs(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.4).select("a", "b", R6("s").alias("cosine"))


LABELS = "lab AS (SELECT vec_id, unnest(range(10)) AS label, unnest([" + ", ".join(_dot(i, "embedding") for i in range(10)) + "]) AS s FROM embeddings), shares AS (SELECT vec_id, label, exp(100 * (s - m)) / sum(exp(100 * (s - m))) OVER (PARTITION BY vec_id) AS share FROM (SELECT *, max(s) OVER (PARTITION BY vec_id) AS m FROM lab)), top AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY share DESC, label) AS r FROM shares)"


def _labelled(spark, sf):
    """vec_id, tags: the three best labels, those with a share of 0.05 and more."""
    x = V.with_shares(table(spark, sf, "embeddings"), V.dots(F.col("embedding"), _prompts(spark, sf)[:10]))
    pairs = F.transform("shares", lambda x, i: F.struct((-x).alias("neg"), i.alias("label")))
    top = F.filter(F.slice(F.array_sort(pairs), 1, 3), lambda t: -t["neg"] >= 0.05)
    return x.select("vec_id", top.alias("top")).select("vec_id", F.transform("top", lambda t: F.struct(t["label"].alias("label"), (-t["neg"]).alias("confidence"))).alias("tags"))


@query("SELECT vec_id, label, round(share, 6) AS confidence FROM top WHERE r <= 3 AND share >= 0.05", LABELS)
def softmax_top3_labels(p, spark, sf):
    t = _labelled(spark, sf).select("vec_id", F.explode("tags").alias("t"))
    return t.select("vec_id", F.col("t.label").cast("long").alias("label"), R6("t.confidence").alias("confidence"))


@query("SELECT vec_id, label FROM top WHERE r = 1", LABELS)
def top_label(p, spark, sf):
    return _labelled(spark, sf).select("vec_id", F.col("tags")[0]["label"].cast("long").alias("label"))


@query("SELECT vec_id, count(*) AS n, round(sum(share), 4) AS total FROM (SELECT vec_id, round(share, 4) AS share FROM top WHERE r <= 3 AND share >= 0.05) GROUP BY vec_id", LABELS)
def scene_tags_json(p, spark, sf):
    told = F.transform("tags", lambda t: F.struct(t["label"].alias("label"), F.round(t["confidence"], 4).alias("confidence")))
    text = _labelled(spark, sf).select("vec_id", F.to_json(told).alias("json"))
    back = F.coalesce(F.from_json("json", "array<struct<label:int,confidence:double>>"), F.array())
    return text.select("vec_id", back.alias("t")).select("vec_id", F.size("t").cast("long").alias("n"), F.round(F.aggregate("t", F.lit(0.0), lambda s, x: s + x["confidence"]), 4).alias("total"))


@query(f"SELECT vec_id, round(least(greatest(({_dot(0, 'embedding')} - {_dot(1, 'embedding')} + 2) / 4, 0), 1), 6) AS score FROM embeddings")
def aesthetic_score(p, spark, sf):
    a = _prompts(spark, sf)
    return table(spark, sf, "embeddings").select("vec_id", R6(V.aesthetic(F.col("embedding"), a[0], a[1])).alias("score"))


@query(f"SELECT id, round(CASE WHEN clip_emb IS NULL THEN 0 ELSE greatest(0, {_dot(2)}) END, 5) AS score FROM photos")
def subject_single(p, spark, sf):
    a = _prompts(spark, sf)
    return p.select("id", F.round(F.coalesce(F.greatest(F.lit(0.0), V.cosine(F.col("clip_emb"), V.literal(a[2]))), F.lit(0.0)), 5).alias("score"))


@query("SELECT id, round(CASE WHEN clip_emb IS NULL THEN 0 ELSE least(1, greatest(0, " + ", ".join(f"{_dot(i)} * {w}" for i, w in SUBJECTS.items()) + ")) END, 5) AS score FROM photos")
def subject_multi_priority(p, spark, sf):
    a = _prompts(spark, sf)
    sims = F.array(*(V.cosine(F.col("clip_emb"), V.literal(a[i])) * w for i, w in SUBJECTS.items()))
    return p.select("id", F.round(F.when(F.col("clip_emb").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.array_max(sims)))), 5).alias("score"))


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE {_dot(i)} >= 0.2) AS subject_{i}" for i in SUBJECTS) + " FROM photos")
def subject_match_counts(p, spark, sf):
    a = _prompts(spark, sf)
    return p.agg(*(F.count_if(V.cosine(F.col("clip_emb"), V.literal(a[i])) >= 0.2).alias(f"subject_{i}") for i in SUBJECTS))


SHARES = "s AS (SELECT vec_id, list_transform(x, lambda y: exp(100 * (y - list_max(x)))) AS e FROM (SELECT vec_id, [" + ", ".join(_dot(i, "embedding") for i in range(6)) + "] AS x FROM embeddings)), q AS (SELECT vec_id, list_transform(e, lambda y: y / list_sum(e)) AS p FROM s)"


@query("SELECT vec_id, list_max(p[1:5]) > 0.4 AND list_max(p[1:5]) >= 3 * greatest(p[6], 1e-6) AS private FROM q", SHARES)
def private_prob_gate(p, spark, sf):
    x = V.with_shares(table(spark, sf, "embeddings"), V.dots(F.col("embedding"), _prompts(spark, sf)[:6]))
    return x.select("vec_id", V.private_by(F.col("shares"), 0.4, 3).alias("private"))


@query("SELECT vec_id, list_max(p[1:5]) > 0.25 AND list_max(p[1:5]) >= 20 * greatest(p[6], 1e-6) AS boring FROM q", SHARES)
def boring_ratio_gate(p, spark, sf):
    x = V.with_shares(table(spark, sf, "embeddings"), V.dots(F.col("embedding"), _prompts(spark, sf)[:6]))
    return x.select("vec_id", V.private_by(F.col("shares"), 0.25, 20).alias("boring"))


@query("SELECT vec_id, greatest(" + ", ".join(f"1 / (1 + exp(100 * ({_dot(9, 'embedding')} - {_dot(i, 'embedding')})))" for i in range(6)) + ") >= 0.55 AS heavy FROM embeddings")
def text_heavy_binary_max(p, spark, sf):
    a = _prompts(spark, sf)
    x = V.with_binary_max(table(spark, sf, "embeddings"), F.col("embedding"), a[:6], a[9], "share")
    return x.select("vec_id", (F.col("share") >= 0.55).alias("heavy"))


# -- gates ------------------------------------------------------------------------------------------------------------

HAVERSINE = "(2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)))"
GEO = f"geo AS (SELECT *, pow(sin(radians({HOME[0]} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({HOME[0]})) * pow(sin(radians({HOME[1]} - lon) / 2), 2) AS h FROM photos), far AS (SELECT *, {HAVERSINE} AS km FROM geo)"
LEAF = "lower(split_part(path, '/', 5))"
RESHARED = "(" + " OR ".join(f"starts_with({LEAF}, '{x}')" for x in gates.RESHARED) + " OR regexp_matches(regexp_replace(split_part(path, '/', 5), '\\.[^.]*$', ''), '^[0-9]{10,13}([-_][0-9]+)?$'))"
CLOSEUP = "(flesh_fraction >= 0 AND flesh_fraction >= 0.65 AND blur_score <= 120)"
PITCH = "(detail_stddev >= 0 AND detail_stddev < 2 AND (exposure_score < 0.05 OR exposure_score > 0.95))"


SIZES = [(w, h) if i % 2 else (h, w) for i, (w, h) in enumerate((*gates.SCREENS, (1000, 1000), (1080, 1080), (640, 480)))]
SHAPES = "shapes AS (SELECT *, [" + ", ".join(f"'{w}x{h}'" for w, h in SIZES) + f"][1 + id % {len(SIZES)}] AS shape FROM photos)"


@query("SELECT id, trim(camera_model) = '' AND has_gps = 0 AND list_contains([" + ", ".join(f"'{a}x{b}', '{b}x{a}'" for a, b in gates.SCREENS) + "], shape) AS screenshot FROM shapes", SHAPES)
def screenshot_gate(p, spark, sf):
    size = lambda k: F.get(F.array(*(F.lit(x[k]) for x in SIZES)), F.expr(f"int(id % {len(SIZES)})"))
    return p.select("id", gates.screenshot(size(0), size(1), F.col("camera_model"), F.col("has_gps")).alias("screenshot"))


@query(f"SELECT id, {CLOSEUP} AS closeup FROM photos")
def closeup_gate(p, spark, sf):
    return p.select("id", gates.closeup(F.col("flesh_fraction"), F.col("blur_score")).alias("closeup"))


@query(f"SELECT id, {PITCH} AS pitch FROM photos")
def pitch_gate(p, spark, sf):
    return p.select("id", gates.pitch(F.col("detail_stddev"), F.col("exposure_score")).alias("pitch"))


@query("SELECT id, NOT (lat = 0 AND lon = 0) AND km <= 3000 AND face_count <= 1 AS home FROM far", GEO)
def home_private(p, spark, sf):
    return p.select("id", gates.home_private(F.col("lat"), F.col("lon"), F.col("face_count"), HOME, 3000).alias("home"))


@query("SELECT id, NOT (lat = 0 AND lon = 0) AND km > 3000 AS rare FROM far", GEO)
def rare_location(p, spark, sf):
    return p.select("id", gates.rare_location(F.col("lat"), F.col("lon"), HOME, 3000).alias("rare"))


@query("SELECT id, round(km, 4) AS km FROM far", GEO)
def haversine(p, spark, sf):
    return p.select("id", F.round(S.haversine_km(F.col("lat"), F.col("lon"), F.lit(HOME[0]), F.lit(HOME[1])), 4).alias("km"))


@query(f"SELECT id, {RESHARED} AS reshared FROM photos")
def reshared_filename(p, spark, sf):
    return p.select("id", gates.reshared(F.col("path")).alias("reshared"))


@query("SELECT id, blur_score >= 50 AND exposure_score >= 0.15 AND exposure_score <= 0.9 AND resolution >= 640 AS passes FROM photos")
def quality_gate(p, spark, sf):
    return p.select("id", gates.quality(F.col("blur_score"), F.col("exposure_score"), F.col("resolution")).alias("passes"))


def _private_vector(p, spark, sf):
    a = _prompts(spark, sf)
    return F.col("clip_emb").isNotNull() & (V.dot(F.col("clip_emb"), V.literal(a[3])) >= 0.2)


REASONS = f"CASE WHEN {RESHARED} THEN 'reshared_filename' WHEN {CLOSEUP} THEN 'accidental_closeup' WHEN {PITCH} THEN 'pitch_black_or_pure_white' WHEN clip_emb IS NOT NULL AND {_dot(3)} >= 0.2 THEN 'document' ELSE '' END"


def _reason(p, spark, sf):
    return gates.first_reason(
        ("reshared_filename", gates.reshared(F.col("path"))), ("screenshot", None), ("accidental_closeup", gates.closeup(F.col("flesh_fraction"), F.col("blur_score"))),
        ("pitch_black_or_pure_white", gates.pitch(F.col("detail_stddev"), F.col("exposure_score"))), ("document", _private_vector(p, spark, sf)),
    )


@query(f"SELECT id, {REASONS} AS reason FROM photos")
def privacy_reason_chain(p, spark, sf):
    return p.select("id", _reason(p, spark, sf).alias("reason"))


@query(f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN r = '' THEN 'unrecorded' ELSE r END AS reason FROM (SELECT {REASONS} AS r FROM photos WHERE is_private = 1)) GROUP BY reason")
def private_breakdown(p, spark, sf):
    r = p.filter("is_private = 1").select(_reason(p, spark, sf).alias("reason"))
    return r.groupBy(F.when(F.col("reason") == "", "unrecorded").otherwise(F.col("reason")).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


@query(f"""SELECT id, CAST(CASE WHEN clip_emb IS NULL THEN is_private WHEN r <> '' THEN 1 WHEN is_private = 1 AND NOT speaks THEN 1 ELSE 0 END AS INTEGER) AS new_private,
  CASE WHEN clip_emb IS NULL THEN prev WHEN r <> '' THEN r WHEN is_private = 1 AND NOT speaks THEN CASE WHEN prev = '' THEN 'preserved_from_ingest' ELSE prev END ELSE '' END AS new_reason
  FROM (SELECT *, {REASONS} AS r, CASE WHEN is_private = 1 AND id % 2 = 0 THEN 'screenshot' ELSE '' END AS prev, trim(camera_model) <> '' OR has_gps > 0 OR face_count > 0 AS speaks FROM photos)""")
def privacy_reassess(p, spark, sf):
    previous = F.when(F.expr("is_private = 1 and id % 2 = 0"), "screenshot").otherwise("")
    return gates.reassess(p, _reason(p, spark, sf), previous).select("id", "new_private", "new_reason")


SOFT = "list_transform({x}, lambda y: exp(100 * (y - list_max({x}))) / list_sum(list_transform({x}, lambda z: exp(100 * (z - list_max({x}))))))"
BY = "(list_max({p}[1:len({p}) - 1]) > {t} AND list_max({p}[1:len({p}) - 1]) >= {r} * greatest({p}[len({p})], 1e-6))"
AGAINST = lambda rows: "greatest(" + ", ".join(f"1 / (1 + exp(100 * (x[10] - x[{i + 1}])))" for i in rows) + ")"
GATED = (
    "dotted AS (SELECT *, [" + ", ".join(_dot(i) for i in PROMPTS) + "] AS x FROM photos WHERE clip_emb IS NOT NULL), "
    "shared AS (SELECT *, " + SOFT.format(x="x") + " AS p11, " + SOFT.format(x="x[1:6]") + " AS p6, " + SOFT.format(x="x[5:10]") + " AS q6 FROM dotted), "
    "judged AS (SELECT id, " + BY.format(p="p11", t=0.4, r=3) + " AS document, " + BY.format(p="p11", t=0.6, r=50) + " AS document_page, " + BY.format(p="p6", t=0.25, r=20) + " AS boring, " + BY.format(p="q6", t=0.25, r=20) + " AS intimate, "
    + AGAINST(range(3)) + " >= 0.55 AS text_heavy, " + AGAINST(range(3, 8)) + " >= 0.62 AS mundane FROM shared), "
    "gated AS (SELECT f.*, document, document_page, boring, intimate, text_heavy, mundane, f.id % 5 < 2 AS page_like, (f.id * 3 % 11) / 10.0::DOUBLE AS plainness, resolution AS width, CAST(floor(resolution * 16 / 9) AS INTEGER) AS height FROM far f LEFT JOIN judged USING (id))"
)
SCREEN = "(trim(camera_model) = '' AND has_gps = 0 AND list_contains([" + ", ".join(f"'{a}x{b}', '{b}x{a}'" for a, b in gates.SCREENS) + "], width || 'x' || height))"
FULL_CHAIN = {
    "reshared_filename": RESHARED, "screenshot": SCREEN, "accidental_closeup": CLOSEUP, "pitch_black_or_pure_white": PITCH, "home_private": "(NOT (lat = 0 AND lon = 0) AND km <= 3000 AND face_count <= 1)", "document": "document",
    "text_heavy": "text_heavy", "text_document_page": "(document_page AND page_like)", "boring_object": "boring", "mundane_object": "mundane", "mundane_heuristic": "(clip_emb IS NULL AND plainness >= 0.8 AND detail_stddev < 12 AND face_count = 0)", "intimate_content": "intimate",
}


def _case(names) -> str:
    return "CASE " + " ".join(f"WHEN {FULL_CHAIN[n]} THEN '{n}'" for n in names) + " ELSE '' END"


def _gated(p, spark, sf):
    a = _prompts(spark, sf)
    x = V.with_shares(p, V.dots(F.col("clip_emb"), a), "p11")
    x = V.with_shares(V.with_shares(x, V.dots(F.col("clip_emb"), a[:6]), "p6"), V.dots(F.col("clip_emb"), a[4:10]), "q6")
    x = V.with_binary_max(V.with_binary_max(x, F.col("clip_emb"), a[:3], a[9], "text"), F.col("clip_emb"), a[3:8], a[9], "plain")
    told = {"document": V.private_by(F.col("p11"), 0.4, 3), "document_page": V.private_by(F.col("p11"), 0.6, 50), "boring": V.private_by(F.col("p6"), 0.25, 20), "intimate": V.private_by(F.col("q6"), 0.25, 20), "text_heavy": F.col("text") >= 0.55, "mundane": F.col("plain") >= 0.62}
    pixels = {"page_like": F.expr("id % 5 < 2"), "plainness": F.expr("(id * 3 % 11) / 10D"), "width": F.col("resolution"), "height": F.expr("int(floor(resolution * 16 / 9))")}
    return x.withColumns({**{k: F.coalesce(v, F.lit(False)) for k, v in told.items()}, **pixels})


@query(f"SELECT id, {_case(FULL_CHAIN)} AS reason FROM gated", f"{GEO}, {GATED}")
def privacy_full_chain(p, spark, sf):
    return _gated(p, spark, sf).select("id", gates.privacy_reason(HOME, 3000).alias("reason"))


@query(f"SELECT id, {_case([n for n in FULL_CHAIN if n not in ('reshared_filename', 'home_private', 'text_heavy', 'text_document_page')])} AS reason FROM gated", f"{GEO}, {GATED}")
def privacy_chain_with_gates_off(p, spark, sf):
    return _gated(p, spark, sf).select("id", gates.privacy_reason(HOME, 3000, frozenset({"reshared_filename", "home_private", "text_heavy"})).alias("reason"))


CACHED = f"CASE WHEN {RESHARED} THEN 'reshared_filename' WHEN {CLOSEUP} THEN 'accidental_closeup' WHEN {PITCH} THEN 'pitch_black_or_pure_white' WHEN document THEN 'document' WHEN text_heavy THEN 'text_heavy' WHEN boring OR mundane THEN 'mundane_object' WHEN intimate THEN 'intimate_content' ELSE '' END"


@query(f"""SELECT count(*) AS n, CAST(sum(CASE WHEN flag <> is_private THEN 1 ELSE 0 END) AS BIGINT) AS changed, count(*) FILTER (WHERE why = 'preserved_from_ingest') AS preserved FROM (
  SELECT is_private, CASE WHEN r <> '' THEN 1 WHEN is_private = 1 AND NOT speaks THEN 1 ELSE 0 END AS flag, CASE WHEN r <> '' THEN r WHEN is_private = 1 AND NOT speaks THEN 'preserved_from_ingest' ELSE '' END AS why
  FROM (SELECT *, {CACHED} AS r, trim(camera_model) <> '' OR has_gps > 0 OR face_count > 0 AS speaks FROM gated WHERE clip_emb IS NOT NULL))""", f"{GEO}, {GATED}")
def privacy_reassess_changed(p, spark, sf):
    x = gates.reassess(_gated(p, spark, sf).filter("clip_emb is not null"), gates.cached_reason(), F.lit(""))
    return x.agg(F.count("*").alias("n"), F.sum("flipped").alias("changed"), F.count_if(F.col("new_reason") == "preserved_from_ingest").alias("preserved"))


# -- times and scalars ------------------------------------------------------------------------------------------------

NAMED = """CASE id % 8 WHEN 1 THEN epoch(date_trunc('day', ts)) + 43200 + id % 60 WHEN 5 THEN 0 WHEN 7 THEN 0 ELSE floor(ep) END"""
TIMES = "named AS (SELECT p.id, p.timestamp, p.path, CAST(CASE p.id % 8 WHEN 1 THEN epoch(date_trunc('day', e.ts)) + 43200 + p.id % 60 WHEN 5 THEN 0 WHEN 7 THEN 0 ELSE floor(epoch(e.ts)) END AS DOUBLE) AS t FROM photos p JOIN events e ON e.event_id = p.id)"


@query("SELECT id, t AS seconds FROM named", TIMES)
def filename_timestamp(p, spark, sf):
    return T.captured(p.select("id", "path"), "path", "seconds").select("id", "seconds")


@query("SELECT id, CASE WHEN timestamp <= 0 AND t > 0 THEN t ELSE timestamp END AS timestamp FROM named", TIMES)
def timestamp_backfill(p, spark, sf):
    return T.captured(p.select("id", "timestamp", "path"), "path", "t").select("id", F.when((F.coalesce("timestamp", F.lit(0.0)) <= 0) & (F.col("t") > 0), F.col("t")).otherwise(F.col("timestamp")).alias("timestamp"))


@query("SELECT id, CASE WHEN id % 17 = 0 THEN 0 WHEN id % 20 > 14 OR (id % 20 = 14 AND id % 70 > 0) OR id % 70 > 59 THEN NULL ELSE (id % 20 * 60 + id % 70) * CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END END AS minutes FROM photos")
def exif_offset(p, spark, sf):
    text = F.expr("case when id % 17 = 0 then 'Z' else concat(case when id % 2 = 0 then '+' else '-' end, lpad(string(id % 20), 2, '0'), case when id % 3 = 0 then ':' else '' end, lpad(string(id % 70), 2, '0')) end")
    return p.select("id", T.exif_offset_minutes(text).cast("long").alias("minutes"))


@query("SELECT id, least(CASE WHEN file_size = 0 THEN 2000000 ELSE coalesce(file_size, 2000000) END, 1536000) AS est FROM photos")
def est_size(p, spark, sf):
    return p.select("id", S.est_size(F.col("file_size")).cast("long").alias("est"))


@query("SELECT id, round(CASE WHEN face_count = 0 THEN 0 ELSE 0.65 * least(1, ln(face_count + 1) / ln(7)) + 0.35 * least(1, 3 * exposure_score) END, 6) AS score FROM photos")
def face_score(p, spark, sf):
    return p.select("id", R6(S.face_score(F.col("face_count"), F.col("exposure_score"))).alias("score"))


@query("SELECT id, CASE WHEN id % 13 = 0 THEN 0 ELSE (id * 7)::DOUBLE / (id % 13) END AS x FROM photos")
def exif_rational(p, spark, sf):
    return p.select("id", X.rational(F.expr("id * 7"), F.expr("id % 13")).alias("x"))


@query("SELECT id, round((id % 90 + id % 60 / 60.0::DOUBLE + id % 50 / 3600.0::DOUBLE) * CASE WHEN id % 3 = 1 THEN -1 ELSE 1 END, 9) AS degrees FROM photos")
def exif_position(p, spark, sf):
    return p.select("id", F.round(X.decimal_degrees(F.expr("double(id % 90)"), F.expr("double(id % 60)"), F.expr("double(id % 50)"), F.expr("case when id % 3 = 1 then ' s' else 'N' end")), 9).alias("degrees"))


@query("SELECT e.event_id AS id, CASE WHEN e.event_id % 4 = 3 THEN NULL ELSE floor(epoch(ts)) - 60 * CASE WHEN e.event_id % 2 = 0 THEN 330 ELSE 0 END END AS t FROM events e")
def exif_capture_time(p, spark, sf):
    """The time stands in the first field, the second, or neither; half of the rows tell an offset."""
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy:MM:dd HH:mm:ss")
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), text.alias("s"))
    first, second = F.expr("case when id % 4 = 0 then s when id % 4 = 2 then '0000:00:00 00:00:00' else '' end"), F.expr("case when id % 4 in (1, 2) then concat(' ', s) end")
    return e.select("id", X.capture_time(first, second, F.expr("case when id % 2 = 0 then '+05:30' end")).alias("t"))


BITS = "bits AS (SELECT vec_id, [x > list_sum(v) / 64 FOR x IN v] AS a, [v[i] < v[i + 1] FOR i IN range(1, 64)] AS d FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)), pairs AS (SELECT x.vec_id AS a, y.vec_id AS b, CAST(list_sum(list_transform(list_zip(x.a, y.a), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS BIGINT) AS first, CAST(list_sum(list_transform(list_zip(x.d, y.d), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS BIGINT) AS second FROM bits x JOIN bits y ON x.vec_id < y.vec_id)"


@query("SELECT a, b, first AS bits FROM pairs WHERE first <= 18", BITS)
def hamming_pairs_le(p, spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", V.sign_bits(F.col("embedding"), "ahash").alias("h"))
    return similarity.hamming_pairs(e, "vec_id", "h", 18).select("a", "b", F.col("s").cast("long").alias("bits"))


@query("SELECT a, b, first, second FROM pairs WHERE first <= 18 AND second <= 30", BITS)
def dual_hash_pairs(p, spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", V.sign_bits(F.col("embedding"), "ahash").alias("h"), V.sign_bits(F.col("embedding"), "dhash").alias("h2"))
    near = similarity.hamming_pairs(e, "vec_id", "h", 18)
    both = near.join(e.select(F.col("vec_id").alias("a"), F.col("h2").alias("x")), "a").join(e.select(F.col("vec_id").alias("b"), F.col("h2").alias("y")), "b")
    return both.select("a", "b", F.col("s").cast("long").alias("first"), F.bit_count(F.col("x").bitwiseXOR(F.col("y"))).cast("long").alias("second")).filter("second <= 30")


# -- ranking ----------------------------------------------------------------------------------------------------------

METRICS = ("blur_score", "aesthetic_score", "smile_score")
RANKED = "raw AS (SELECT photos.*, ln(1 + least(greatest(face_count, 0), 10)::DOUBLE) AS faces, CASE WHEN has_gps > 0 THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END * CASE WHEN timestamp > 0 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS meta, CASE WHEN cluster_id < 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / count(*) OVER (PARTITION BY cluster_id) END AS uniq, CASE WHEN cluster_id < 0 THEN 0.0::DOUBLE ELSE (count(*) OVER (PARTITION BY cluster_id))::DOUBLE / (SELECT max(n) FROM (SELECT count(*) AS n FROM photos WHERE cluster_id >= 0 GROUP BY cluster_id)) END AS div FROM photos), ranked AS (SELECT *, 0.05 * 0.5 + 0.10 * 0.5 + " + " + ".join(f"{w}::DOUBLE * CASE WHEN max({c}) OVER () - min({c}) OVER () < 1e-8 THEN 0.5 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END" for c, w in (("blur_score", 0.1), ("aesthetic_score", 0.2), ("faces", 0.18), ("smile_score", 0.18), ("uniq", 0.1), ("meta", 0.05), ("div", 0.04))) + " AS score FROM raw)"


@query("SELECT id, " + ", ".join(f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}" for c in METRICS) + " FROM photos")
def minmax_metrics(p, spark, sf):
    ends = p.agg(*(f(c).alias(f"{n}_{c}") for c in METRICS for n, f in (("lo", F.min), ("hi", F.max))))
    return p.select("id", *METRICS).crossJoin(F.broadcast(ends)).select("id", *(R6(S.minmax(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"))).alias(c) for c in METRICS))


@query("SELECT id, round(score, 6) AS score FROM ranked", RANKED)
def composite_rank(p, spark, sf):
    return ranking.score(p).select("id", R6("score").alias("score"))


@query("SELECT id, round(score, 6) AS score FROM ranked ORDER BY ranked.score DESC, path LIMIT 50", RANKED)
def rank_topk(p, spark, sf):
    return ranking.score(p).orderBy(F.desc("score"), "path").limit(50).select("id", R6("score").alias("score"))


@query("SELECT id FROM ranked WHERE score >= (SELECT quantile_cont(score, 0.2) FROM ranked)", RANKED)
def percentile_floor(p, spark, sf):
    s = store.stored(ranking.score(p).select("id", "score"), "scored")
    floor = s.agg(F.percentile("score", F.lit(0.2)).alias("floor"))
    return s.crossJoin(F.broadcast(floor)).filter("score >= floor").select("id")


# -- windows and sessions ---------------------------------------------------------------------------------------------

BURSTS = "timed AS (SELECT event_id, value, epoch(ts)::DOUBLE AS t FROM events), gaps AS (SELECT *, CASE WHEN t - lag(t) OVER (ORDER BY t, event_id) <= 30 THEN 0 ELSE 1 END AS new FROM timed), bursts AS (SELECT *, CAST(sum(new) OVER (ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM gaps)"


def _timed(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"))


@query("SELECT event_id, session FROM bursts", BURSTS)
def burst_sessions(p, spark, sf):
    return ordered.gap_sessions(_timed(spark, sf), "t", 30, "event_id").select("event_id", F.col("session").cast("long").alias("session"))


def _burst_duplicates(spark, sf):
    b = ordered.gap_sessions(_timed(spark, sf), "t", 30, "event_id")
    w = Window.partitionBy("session").orderBy(F.desc("value"), "t", "event_id")
    return b.withColumn("r", F.row_number().over(w)).filter("r > 1").select("event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY session ORDER BY value DESC, t, event_id) AS r FROM bursts) WHERE r > 1", BURSTS)
def burst_duplicates(p, spark, sf):
    return _burst_duplicates(spark, sf)


@query("SELECT user_id, CAST(sum(new) AS BIGINT) AS sessions, count(*) AS n FROM (SELECT user_id, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3600 THEN 0 ELSE 1 END AS new FROM events) GROUP BY user_id")
def sessions_per_user(p, spark, sf):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = _timed(spark, sf).withColumn("new", F.when(F.col("t") - F.lag("t").over(w) <= 3600, 0).otherwise(1))
    return e.groupBy("user_id").agg(F.sum("new").alias("sessions"), F.count("*").alias("n"))


DAY = "CASE WHEN timestamp <= 0 THEN 'none ' || path ELSE strftime(make_timestamp(CAST(floor(timestamp) AS BIGINT) * 1000000), '%Y%j') END"
HOUR = "CASE WHEN timestamp <= 0 THEN 'none ' || path ELSE strftime(make_timestamp(CAST(floor(timestamp) AS BIGINT) * 1000000), '%Y%j%H') END"


@query(f"SELECT {DAY} AS day, count(*) AS n FROM photos GROUP BY 1")
def day_counts(p, spark, sf):
    return p.groupBy(selection.day_key().alias("day")).agg(F.count("*").alias("n"))


@query(f"SELECT {HOUR} AS hour, count(*) AS n FROM photos GROUP BY 1")
def hour_counts(p, spark, sf):
    return p.groupBy(selection.hour_key().alias("hour")).agg(F.count("*").alias("n"))


@query("SELECT cluster_id, round(CASE WHEN n < 2 THEN 0 WHEN least(n * 0.5, greatest(0.5, d / 120), 5) <= 1 THEN 600 ELSE least(600, greatest(60, d / least(n * 0.5, greatest(0.5, d / 120), 5) * 0.6)) END, 6) AS spacing FROM (SELECT cluster_id, count(*) AS n, max(timestamp) - min(timestamp) AS d FROM photos WHERE cluster_id >= 0 AND timestamp > 0 GROUP BY cluster_id)")
def cluster_span_spacing(p, spark, sf):
    return selection.spacing(p, 0.5, 5, 600.0).select("cluster_id", R6("spacing").alias("spacing"))


@query(f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY {DAY} ORDER BY aesthetic_score DESC, path) AS r FROM photos) WHERE r = 1")
def best_per_day(p, spark, sf):
    return p.withColumn("r", F.row_number().over(Window.partitionBy(selection.day_key()).orderBy(F.desc("aesthetic_score"), "path"))).filter("r = 1").select("id")


@query("SELECT id, cluster_id FROM (SELECT id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY aesthetic_score DESC, path) AS r FROM photos WHERE cluster_id >= 0) WHERE r = 1")
def best_per_cluster(p, spark, sf):
    w = Window.partitionBy("cluster_id").orderBy(F.desc("aesthetic_score"), "path")
    return p.filter("cluster_id >= 0").withColumn("r", F.row_number().over(w)).filter("r = 1").select("id", "cluster_id")


@query("SELECT id, person_id FROM (SELECT id, person_id, row_number() OVER (PARTITION BY person_id ORDER BY aesthetic_score DESC, path) AS r FROM photos WHERE person_id >= 0) WHERE r <= 5")
def cap_per_person(p, spark, sf):
    w = Window.partitionBy("person_id").orderBy(F.desc("aesthetic_score"), "path")
    return p.filter("person_id >= 0").withColumn("r", F.row_number().over(w)).filter("r <= 5").select("id", "person_id")


@query("SELECT id, used FROM (SELECT id, CAST(sum(least(file_size, 1536000)) OVER (ORDER BY aesthetic_score DESC, path ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM photos) WHERE used <= 200000000")
def running_byte_budget(p, spark, sf):
    x = ordered.running(p, F.floor(-F.col("aesthetic_score") * 100), [F.desc("aesthetic_score"), F.col("path")], S.est_size(F.col("file_size")).cast("long"), "used")
    return x.filter("used <= 200000000").select("id", "used")


@query(f"SELECT id, turn FROM (SELECT id, row_number() OVER (PARTITION BY {DAY} ORDER BY aesthetic_score DESC, path) AS turn FROM photos) WHERE turn <= 2")
def round_robin_days(p, spark, sf):
    w = Window.partitionBy(selection.day_key()).orderBy(F.desc("aesthetic_score"), "path")
    return p.withColumn("turn", F.row_number().over(w).cast("long")).filter("turn <= 2").orderBy("turn", "path").select("id", "turn")


# -- duplicates and clusters ------------------------------------------------------------------------------------------

GREEDY = """ranks AS (SELECT vec_id AS id, row_number() OVER (ORDER BY label DESC, vec_id) AS rank FROM embeddings),
near AS (SELECT x.id AS a, y.id AS b, x.rank AS ra, y.rank AS rb FROM ranks x JOIN ranks y ON x.rank < y.rank JOIN embeddings u ON u.vec_id = x.id JOIN embeddings v ON v.vec_id = y.id WHERE list_cosine_similarity(u.embedding::DOUBLE[], v.embedding::DOUBLE[]) >= 0.4),
earlier AS (SELECT rb AS rank, list(ra) AS nbrs FROM near GROUP BY rb),
touched AS (SELECT rank, row_number() OVER (ORDER BY rank) AS k, nbrs FROM earlier),
walk(k, dropped) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT w.k + 1, CASE WHEN len(list_filter(t.nbrs, lambda x: NOT list_contains(w.dropped, x))) > 0 THEN list_append(w.dropped, t.rank) ELSE w.dropped END FROM walk w JOIN touched t ON t.k = w.k + 1)"""


@query("SELECT id FROM ranks WHERE rank IN (SELECT unnest(dropped) FROM walk WHERE k = (SELECT max(k) FROM walk))", GREEDY)
def near_dup_greedy_cosine(p, spark, sf):
    e = table(spark, sf, "embeddings")
    items = e.select(F.col("vec_id").alias("id"), F.struct((-F.col("label")).alias("l"), "vec_id").alias("rank"))
    return graphs.greedy_kept(items, similarity.cosine_pairs(e, "vec_id", "embedding", 0.4)).filter("not kept").select("id")


GREEDY_BITS = BITS + ", " + GREEDY.replace(GREEDY[GREEDY.index("near AS (") : GREEDY.index("earlier AS")], "near AS (SELECT x.id AS a, y.id AS b, x.rank AS ra, y.rank AS rb FROM pairs p JOIN ranks x ON x.id IN (p.a, p.b) JOIN ranks y ON y.id IN (p.a, p.b) AND x.rank < y.rank WHERE p.first <= 18),\n")


@query("SELECT id FROM ranks WHERE rank IN (SELECT unnest(dropped) FROM walk WHERE k = (SELECT max(k) FROM walk))", GREEDY_BITS)
def near_dup_greedy_hamming(p, spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", V.sign_bits(F.col("embedding"), "ahash").alias("h"))
    items = e.select(F.col("vec_id").alias("id"), F.struct((-F.col("label")).alias("l"), "vec_id").alias("rank"))
    return graphs.greedy_kept(items, similarity.hamming_pairs(e, "vec_id", "h", 18)).filter("not kept").select("id")


@query("SELECT event_id AS id FROM (SELECT event_id, row_number() OVER (PARTITION BY session ORDER BY value DESC, t, event_id) AS r FROM bursts) WHERE r > 1 UNION SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY file_hash ORDER BY blur_score DESC, file_size DESC, id) AS r FROM photos) WHERE r > 1", BURSTS)
def dup_union_burst(p, spark, sf):
    return _burst_duplicates(spark, sf).select(F.col("event_id").alias("id")).union(exact_duplicates(p, spark, sf).select("id")).distinct()


# With two samples a cluster is what reaches on, so events in one dimension of scaled time split at gaps over eps.
EVENTS = "timed AS (SELECT event_id AS id, epoch(ts)::DOUBLE AS x FROM events), marks AS (SELECT *, CASE WHEN x - lag(x) OVER (ORDER BY x, id) <= 180 THEN 0 ELSE 1 END AS new FROM timed), runs AS (SELECT *, sum(new) OVER (ORDER BY x, id ROWS UNBOUNDED PRECEDING) AS run FROM marks)"


@query("SELECT id, CASE WHEN count(*) OVER (PARTITION BY run) > 1 THEN min(id) OVER (PARTITION BY run) ELSE -1 END AS cluster FROM runs", EVENTS)
def event_clusters(p, spark, sf):
    """Density clusters in the one dimension of time are its gap sessions, so no graph is needed."""
    s = ordered.gap_sessions(_timed(spark, sf), "t", 180, "event_id").select(F.col("event_id").alias("id"), "session")
    ends = s.groupBy("session").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    return s.join(ends, "session").select("id", F.when(F.col("n") > 1, F.col("first")).otherwise(F.lit(-1)).alias("cluster"))


PLACED = """feat AS (SELECT id, CASE WHEN timestamp > 0 THEN (timestamp - (SELECT min(timestamp) FROM photos WHERE timestamp > 0)) / 3600 ELSE 1e6 + 100 * id END AS t,
  CASE WHEN lat <> 0 OR lon <> 0 THEN lat ELSE (SELECT avg(lat) FROM photos WHERE lat <> 0 OR lon <> 0) END * 2 AS la, CASE WHEN lat <> 0 OR lon <> 0 THEN lon ELSE (SELECT avg(lon) FROM photos WHERE lat <> 0 OR lon <> 0) END * 2 AS lo FROM photos),
pairs AS (SELECT a.id AS a, b.id AS b FROM feat a JOIN feat b ON a.id <> b.id AND pow(a.t - b.t, 2) + pow(a.la - b.la, 2) + pow(a.lo - b.lo, 2) <= 36),
reach(id, root) AS (SELECT id, id FROM feat UNION SELECT p.b, r.root FROM reach r JOIN pairs p ON p.a = r.id),
placed AS (SELECT id, min(root) AS root FROM reach GROUP BY id)"""


@query("SELECT id, CASE WHEN count(*) OVER (PARTITION BY root) > 1 THEN root ELSE -1 END AS cluster FROM placed", PLACED)
def event_clusters_in_space(p, spark, sf):
    """Density clusters over scaled time and place, by an eps join over grid cells."""
    x = features.scaled(p, F.col("id"), gps_weight=0.02)
    return density.clusters(x.select("id", F.array("f_time", "f_lat", "f_lon").alias("f")), 6.0).select("id", "cluster")


IDENTITY = """pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.42),
reach(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.root FROM reach r JOIN pairs p ON p.a = r.id),
ident AS (SELECT id, min(root) AS root FROM reach GROUP BY id), people AS (SELECT id, CASE WHEN count(*) OVER (PARTITION BY root) > 1 THEN root ELSE -1 END AS person FROM ident)"""


def _identities(spark, sf):
    """Unit vectors within a distance are those with a cosine of 1 - d * d / 2 and more."""
    e = table(spark, sf, "embeddings")
    return graphs.dbscan_pairs(e.select(F.col("vec_id").alias("id")), similarity.cosine_pairs(e, "vec_id", "embedding", 0.42)).select("id", F.col("cluster").alias("person"))


@query("SELECT id, person FROM people", IDENTITY)
def identity_clusters(p, spark, sf):
    return _identities(spark, sf)


@query("SELECT person, count(*) AS n FROM people WHERE person >= 0 GROUP BY person HAVING count(*) >= 3", IDENTITY)
def frequent_people(p, spark, sf):
    return _identities(spark, sf).filter("person >= 0").groupBy("person").agg(F.count("*").alias("n")).filter("n >= 3")


@query("SELECT person_id, count(*) AS n, sum(id) AS ids FROM photos WHERE person_id >= 0 GROUP BY person_id")
def photos_per_person(p, spark, sf):
    return p.filter("person_id >= 0").groupBy("person_id").agg(F.count("*").alias("n"), F.sum("id").cast("decimal(38,0)").alias("ids"))


@query("SELECT event_id AS id FROM (SELECT event_id, row_number() OVER (PARTITION BY session ORDER BY value DESC, t, event_id) AS r FROM bursts) WHERE r > 1 EXCEPT SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY file_hash ORDER BY blur_score DESC, file_size DESC, id) AS r FROM photos) WHERE r > 1", BURSTS)
def dup_burst_only(p, spark, sf):
    return _burst_duplicates(spark, sf).select(F.col("event_id").alias("id")).join(exact_duplicates(p, spark, sf).select("id"), "id", "left_anti")


@query("SELECT id, path FROM photos WHERE face_count > 0 AND id % 4 < 3")
def scanned_with_faces(p, spark, sf):
    """Scanned paths that the store has with faces."""
    return p.filter("id % 4 < 3").select("id", "path").join(p.filter("face_count > 0").select("path"), "path", "left_semi").select("id", "path")


@query("SELECT id FROM photos WHERE face_count >= 1 AND coalesce(CASE WHEN id % 3 > 0 THEN id % 3 END, 0) < 2")
def faces_to_refresh(p, spark, sf):
    """Items with faces whose vectors an older model made."""
    return p.withColumn("version", F.expr("case when id % 3 > 0 then id % 3 end")).filter((F.col("face_count") >= 1) & (F.coalesce("version", F.lit(0)) < 2)).select("id")


@query("SELECT query, id, round(d, 6) AS distance FROM (SELECT q.vec_id AS query, e.vec_id AS id, 1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) AS r FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id) WHERE r <= 10 AND id % 2 = 0 AND d <= 0.7")
def knn_accepted(p, spark, sf):
    """Of the nearest ten, those accepted before (even ids) within a cosine distance."""
    e = table(spark, sf, "embeddings")
    near = similarity.nearest(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", 10).withColumn("d", 1 - F.col("s"))
    accepted = e.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("id"))
    return near.join(accepted, "id", "left_semi").filter("d <= 0.7").select("query", "id", R6("d").alias("distance"))


# -- aggregates -------------------------------------------------------------------------------------------------------


@query("SELECT count(DISTINCT cluster_id) FILTER (WHERE cluster_id >= 0) AS events, round(avg(lat) FILTER (WHERE lat <> 0 OR lon <> 0), 6) AS lat, round(avg(lon) FILTER (WHERE lat <> 0 OR lon <> 0), 6) AS lon, min(timestamp) FILTER (WHERE timestamp > 0) AS first_ts, round(avg(least(file_size, 1536000)), 4) AS avg_est, count(*) FILTER (WHERE clip_emb IS NULL) AS without_vector FROM photos")
def library_summary(p, spark, sf):
    located = (F.col("lat") != 0) | (F.col("lon") != 0)
    return p.agg(
        F.countDistinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("events"), R6(F.avg(F.when(located, F.col("lat")))).alias("lat"), R6(F.avg(F.when(located, F.col("lon")))).alias("lon"),
        F.min(F.when(F.col("timestamp") > 0, F.col("timestamp"))).alias("first_ts"), F.round(F.avg(S.est_size(F.col("file_size"))), 4).alias("avg_est"), F.count_if(F.col("clip_emb").isNull()).alias("without_vector"),
    )


@query("SELECT label, pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(64)) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY label, pos")
def vector_means(p, spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.posexplode(V.doubles(F.col("embedding"))).alias("pos", "x"))
    return e.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(R6(F.avg("x")).alias("mean"))


@query("SELECT label, pos, round(mean / norm, 6) AS x FROM (SELECT *, sqrt(sum(mean * mean) OVER (PARTITION BY label)) AS norm FROM (SELECT label, pos, avg(x) AS mean FROM (SELECT label, unnest(range(64)) AS pos, unnest(list_transform(embedding::DOUBLE[], lambda v: v / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))) AS x FROM embeddings) GROUP BY label, pos))")
def label_directions(p, spark, sf):
    """The mean of each label's unit vectors, of length one again."""
    e = table(spark, sf, "embeddings").withColumn("n", V.norm(F.col("embedding"))).select("label", "n", F.posexplode(V.doubles(F.col("embedding"))).alias("pos", "x"))
    mean = e.groupBy("label", "pos").agg(F.avg(F.col("x") / F.col("n")).alias("mean"))
    lengths = mean.groupBy("label").agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("norm"))
    return mean.join(lengths, "label").select("label", F.col("pos").cast("long").alias("pos"), R6(F.col("mean") / F.col("norm")).alias("x"))


@query("SELECT count(*) AS processed, count(*) FILTER (WHERE file_size = 0) AS unreadable, count(*) FILTER (WHERE clip_emb IS NULL) AS zero_emb, count(*) FILTER (WHERE face_count = 0) AS without_faces, count(*) FILTER (WHERE timestamp <= 0) AS undated FROM photos")
def run_counters(p, spark, sf):
    return p.agg(F.count("*").alias("processed"), *(F.count_if(F.expr(e)).alias(n) for n, e in (("unreadable", "file_size = 0"), ("zero_emb", "clip_emb is null"), ("without_faces", "face_count = 0"), ("undated", "timestamp <= 0"))))


@query("SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderpriority)")
def revenue_rollup(p, spark, sf):
    x = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return x.rollup("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


# -- selection --------------------------------------------------------------------------------------------------------

POOL = "eligible AS (SELECT * FROM photos WHERE is_private = 0 AND blur_score >= 50), need AS (SELECT CAST(floor(count(*) * 0.97) AS BIGINT) - count(*) FILTER (WHERE quality_pass <> 0) AS n FROM eligible), rest AS (SELECT id, row_number() OVER (ORDER BY aesthetic_score DESC, path) AS r FROM eligible WHERE quality_pass = 0)"


@query("SELECT id FROM eligible WHERE quality_pass <> 0 UNION ALL SELECT id FROM rest WHERE r <= (SELECT n FROM need)", POOL)
def strict_fallback_pool(p, spark, sf):
    items = p.withColumns({"score": F.col("aesthetic_score"), "is_duplicate": F.lit(0)})
    return selection.pool(items, selection.Rules(min_pool_fraction=0.97)).select("id")


def _candidates(p, spark, sf):
    a = _prompts(spark, sf)
    like = lambda i: F.coalesce(F.greatest(F.lit(0.0), V.cosine(F.col("clip_emb"), V.literal(a[i]))), F.lit(0.0))
    often = Window.partitionBy("person_id")
    x = ranking.score(p).withColumn("is_frequent", ((F.col("person_id") >= 0) & (F.count("*").over(often) >= 3)).cast("int"))
    return x.withColumns({"is_duplicate": F.lit(0), "subjects": F.create_map(F.lit("bike"), like(0), F.lit("landscape"), like(1))})


@query(None)
def select_count_mode(p, spark, sf):
    return selection.select(_candidates(p, spark, sf), selection.Rules(percentage=0.15))


@query(None)
def select_bytes_mode(p, spark, sf):
    return selection.select(_candidates(p, spark, sf), selection.Rules(max_bytes=100_000_000))


CHOSEN = RANKED + ", chosen AS (SELECT *, row_number() OVER (ORDER BY ranked.score DESC, path) AS pick FROM ranked)"


def _chosen(p):
    top = ranking.score(p)
    return ordered.running(top, F.floor(-F.col("score") * 1000), [F.desc("score"), F.col("path")], F.lit(1), "pick")


@query("SELECT id, round(score, 4) AS score, round(aesthetic_score, 3) AS aesthetic, round(smile_score, 3) AS sentiment, face_count AS faces, cluster_id AS cluster, round(blur_score, 2) AS blur, camera_model AS camera FROM chosen", CHOSEN)
def report_rows(p, spark, sf):
    return _chosen(p).select("id", F.round("score", 4).alias("score"), F.round("aesthetic_score", 3).alias("aesthetic"), F.round("smile_score", 3).alias("sentiment"), F.col("face_count").alias("faces"), F.col("cluster_id").alias("cluster"), F.round("blur_score", 2).alias("blur"), F.col("camera_model").alias("camera"))


@query("SELECT id, CASE WHEN f = 1 THEN 'img_' || id % 5 || '.jpg' ELSE 'img_' || id % 5 || '__' || id % 3 || '_' || row_number() OVER (PARTITION BY id % 5, id % 3, f = 1 ORDER BY pick) || '.jpg' END AS filename FROM (SELECT id, pick, row_number() OVER (PARTITION BY id % 5 ORDER BY pick) AS f FROM chosen)", CHOSEN)
def output_names(p, spark, sf):
    named = _chosen(p).withColumn("path", F.expr("concat('/lib/', string(id % 3), '/img_', string(id % 5), '.png')"))
    return selection.report(named).select("id", "filename")


# -- images, landmarks, boxes -----------------------------------------------------------------------------------------

PIXELS = "px AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(128 + 200 * x::DOUBLE) AS DOUBLE)) AS v FROM embeddings), lap AS (SELECT vec_id, v, list_transform(range(36), lambda k: v[(k // 6 + 1) * 8 + k % 6 + 1] + v[(k // 6 + 1) * 8 + k % 6 + 3] + v[(k // 6) * 8 + k % 6 + 2] + v[(k // 6 + 2) * 8 + k % 6 + 2] - 4 * v[(k // 6 + 1) * 8 + k % 6 + 2]) AS l FROM px)"


@query("SELECT vec_id, round(list_var_pop(l), 4) AS blur, round(list_avg(v) / 255, 6) AS exposure, round(list_stddev_pop(v), 4) AS detail FROM lap", PIXELS)
def image_luma_metrics(p, spark, sf):
    """The 64 components as an image of 8 by 8 grey pixels."""
    grey = F.transform(V.doubles(F.col("embedding")), lambda x: F.lpad(F.hex(F.floor(128 + 200 * x)), 2, "0"))
    px = table(spark, sf, "embeddings").select("vec_id", F.unhex(F.concat_ws("", grey)).alias("pixels"))
    m = px.select("vec_id", I.image_metrics(F.lit(8), F.lit(8), "pixels").alias("m"))
    return m.select("vec_id", F.round("m.blur", 4).alias("blur"), R6("m.exposure").alias("exposure"), F.round("m.detail", 4).alias("detail"))


POINTS = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), f AS (SELECT vec_id, least(greatest(((abs(v[18] - v[22]) + abs(v[19] - v[21])) / (2 * abs(v[1] - v[4]) + 1e-8) + (abs(v[24] - v[28]) + abs(v[25] - v[27])) / (2 * abs(v[7] - v[10]) + 1e-8)) / 2 / 0.2, 0), 1) AS eyes, least(greatest((v[31] - (v[29] + v[30]) / 2) * 25 + 0.5, 0), 1) AS smile FROM e)"


@query("SELECT vec_id, round(0.55 * eyes + 0.45 * smile, 6) AS sentiment FROM f", POINTS)
def landmark_sentiment(p, spark, sf):
    """The components as the coordinates of 16 points: x first, then y."""
    v = V.doubles(F.col("embedding"))
    points = F.zip_with(F.slice(v, 1, 16), F.slice(v, 17, 16), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    told = I.sentiment(F.col("points"), (0, 1, 2, 3, 4, 5), (6, 7, 8, 9, 10, 11), {"left": 12, "right": 13, "upper": 14})
    return table(spark, sf, "embeddings").select("vec_id", points.alias("points")).select("vec_id", R6(told).alias("sentiment"))


@query("SELECT l_orderkey AS id, CAST(count(*) FILTER (WHERE good) AS INTEGER) AS count, round(least(1, coalesce(sum(l_quantity) FILTER (WHERE good), 0) / 200), 6) AS prominence, round(coalesce(avg(l_discount) FILTER (WHERE good), 0), 6) AS confidence FROM (SELECT *, l_discount >= 0.04 AND l_quantity >= 10 AS good FROM lineitem) GROUP BY l_orderkey")
def face_boxes(p, spark, sf):
    boxes = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("area"), F.col("l_discount").alias("p"))).alias("b"))
    s = boxes.select(F.col("l_orderkey").alias("id"), I.face_summary(F.col("b"), F.lit(200.0), 0.04, 0.05).alias("s"))
    return s.select("id", "s.count", R6("s.prominence").alias("prominence"), R6("s.confidence").alias("confidence"))


@query("SELECT id, round(CASE WHEN timestamp > 0 THEN (timestamp - (SELECT min(timestamp) FROM photos WHERE timestamp > 0)) / 3600 ELSE 1e6 + 100 * id END, 4) AS t, round(CASE WHEN lat <> 0 OR lon <> 0 THEN lat ELSE (SELECT avg(lat) FROM photos WHERE lat <> 0 OR lon <> 0) END * 200, 3) AS la, round(CASE WHEN lat <> 0 OR lon <> 0 THEN lon ELSE (SELECT avg(lon) FROM photos WHERE lat <> 0 OR lon <> 0) END * 200, 3) AS lo FROM photos")
def event_features(p, spark, sf):
    x = features.scaled(p, F.col("id"))
    return x.select("id", F.round("f_time", 4).alias("t"), F.round("f_lat", 3).alias("la"), F.round("f_lon", 3).alias("lo"))
