"""Captions, hashes, chains, catalogues and logs over documents, conversations, pages and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.operators import catalogue as cat
from airlens.operators import texts as tx
from airlens.plans.registry import query

c = F.col
# captions: every line of a document is a caption two seconds long; some lines announce milestones
_WORD = "CASE (doc_id + i) % 11 WHEN 0 THEN ' liftoff' WHEN 1 THEN ' at Max-Q now' WHEN 2 THEN ' MECO' WHEN 3 THEN ' stage separation' WHEN 4 THEN ' SECO' WHEN 5 THEN ' has landed' WHEN 6 THEN ' <i>abort</i>' ELSE '' END"


def _srt(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"[\r\f\v]", " "), "<|>|-->", " "))), lambda x: x != "").alias("ls"))
    stamp = lambda s: F.format_string("%02d:%02d:%02d,500", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    word = lambda k: F.when(k == 0, " liftoff").when(k == 1, " at Max-Q now").when(k == 2, " MECO").when(k == 3, " stage separation").when(k == 4, " SECO").when(k == 5, " has landed").when(k == 6, " <i>abort</i>").otherwise("")
    blocks = F.transform("ls", lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), stamp(i * 3), F.lit(" --> "), stamp(i * 3 + 2), F.lit("\n"), x, word((c("doc_id") + i) % 11)))
    return d.select(c("doc_id").alias("stream"), F.array_join(blocks, "\n\n").alias("text"))


_SRT = f"""ln AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '[\\r\\f\\v]', ' ', 'g'), '<|>|-->', ' ', 'g'))), lambda x: x <> '') AS ls FROM documents),
cp0 AS (SELECT doc_id, unnest(ls) AS x, unnest(range(0, len(ls))) AS i FROM ln),
cp AS (SELECT doc_id AS stream, i AS block, i * 3 + 0.5 AS start_s, i * 3 + 2.5 AS end_s, trim(x || replace(replace({_WORD}, '<i>', ''), '</i>', '')) AS caption FROM cp0),
ms AS (SELECT stream, kind, arg_min(start_s, block) AS t_s FROM (""" + " UNION ALL ".join(f"SELECT stream, block, start_s, '{k}' AS kind FROM cp WHERE regexp_matches(lower(caption), '{p}')" for k, p in tx.MILESTONES) + ") AS q GROUP BY ALL)"


@query("caption_blocks", f"WITH {_SRT} SELECT stream, CAST(count(*) AS BIGINT) AS captions, min(start_s) AS first_s, max(end_s) AS last_s, CAST(sum(length(caption)) AS BIGINT) AS chars FROM cp GROUP BY ALL")
def caption_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-14."""
    return tx.captions(_srt(spark, sf)).groupBy("stream").agg(F.count(F.lit(1)).alias("captions"), F.min("start_s").alias("first_s"), F.max("end_s").alias("last_s"), F.sum(F.length("caption")).alias("chars"))


@query("caption_milestones", f"WITH {_SRT} SELECT * FROM ms")
def caption_milestones(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-18."""
    return tx.milestones(tx.captions(_srt(spark, sf)))


@query("milestone_gaps", f"""WITH {_SRT}, p AS (SELECT stream, {', '.join(f"min(t_s) FILTER (kind = '{k}') AS {k}" for k, _ in tx.MILESTONES)} FROM ms GROUP BY ALL)
  SELECT stream, max_q - liftoff AS liftoff_to_max_q, meco - liftoff AS liftoff_to_meco, stage_separation - meco AS meco_to_stage_separation, seco - liftoff AS liftoff_to_seco, landing - liftoff AS liftoff_to_landing FROM p""")
def milestone_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-28."""
    return tx.milestone_gaps(tx.milestones(tx.captions(_srt(spark, sf))))


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


_SPLIT = "CASE WHEN CAST('0x' || substr(sha256(text), 1, 4) AS INTEGER) / 65536.0 < 0.2 THEN 'val' ELSE 'train' END"


@query("content_hash_split", f"SELECT doc_id, sha256(text) AS sha256, {_SPLIT} AS split FROM documents")
def content_hash_split(spark: SparkSession, sf: str) -> DataFrame:
    """SCL-18: whole texts hashed."""
    return _docs(spark, sf).withColumn("sha256", F.sha2("text", 256)).select("doc_id", "sha256", tx.split_for(c("sha256")).alias("split"))


@query("dataset_manifest", f"SELECT lang AS label, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val FROM (SELECT lang, {_SPLIT} AS split FROM documents) AS q GROUP BY ALL")
def dataset_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-30."""
    d = _docs(spark, sf).select(c("lang").alias("label"), tx.split_for(F.sha2("text", 256)).alias("split"))
    return d.groupBy("label").agg(F.count_if(c("split") == "train").alias("train"), F.count_if(c("split") == "val").alias("val"))


@query("git_blob_hash", "SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text))) || unhex('00') || encode(text)) AS blob_sha1 FROM documents")
def git_blob_hash(spark: SparkSession, sf: str) -> DataFrame:
    """SCL-19."""
    return _docs(spark, sf).select("doc_id", tx.git_blob_sha1(c("text")).alias("blob_sha1"))


@query("content_duplicates", "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY ALL HAVING count(*) > 1")
def content_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """SET-05 on content hashes; only the hash travels."""
    return _docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("sha256")).groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


@query("url_slugs", "SELECT page_id, substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM pages")
def url_slugs(spark: SparkSession, sf: str) -> DataFrame:
    """SCL-22."""
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", tx.slug(c("url")).alias("slug"))


@query("notice_headlines", """SELECT doc_id, substr(trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#'))[1]), 1, 160) AS headline FROM documents""")
def notice_headlines(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-17."""
    return _docs(spark, sf).select("doc_id", tx.headline(c("text")).alias("headline"))


# ---- log chains: a conversation is a log; some logs are damaged
def _logs(spark: SparkSession, sf: str) -> DataFrame:
    from airlens.operators.ordered import with_previous

    t = spark.read.parquet(f"{sf}/conversations.parquet").select(c("conv_id").alias("log"), (c("turn") + 1).alias("line"), (c("turn") + 1).alias("seq"), F.concat_ws("|", c("turn") + 1, "role", F.sha2("text", 256)).alias("body"))
    t = with_previous(t.withColumn("hash", F.sha2("body", 256)), ["log"], F.floor(c("line") / 1000), ["line"], ["hash"], "p")
    t = t.withColumn("prev", F.coalesce("p.hash", F.lit(tx.GENESIS))).drop("p")
    t = t.withColumn("body", F.when((c("log") % 5 == 1) & (c("line") == 2), F.concat("body", F.lit("x"))).otherwise(c("body")))  # edited
    t = t.withColumn("prev", F.when((c("log") % 5 == 2) & (c("line") == 3), F.lit("0")).otherwise(c("prev")))  # reordered
    return t.withColumn("hash", F.when((c("log") % 5 == 3) & (c("line") == 1), None).otherwise(c("hash")))  # from before chaining


_LOGS = """l0 AS (SELECT conv_id AS log, turn + 1 AS line, turn + 1 AS seq, concat_ws('|', turn + 1, role, sha256(text)) AS body FROM conversations), l1 AS (SELECT *, sha256(body) AS h, coalesce(lag(sha256(body)) OVER (PARTITION BY log ORDER BY line), repeat('0', 64)) AS pv FROM l0),
l2 AS (SELECT log, line, seq, CASE WHEN log % 5 = 1 AND line = 2 THEN body || 'x' ELSE body END AS body, CASE WHEN log % 5 = 2 AND line = 3 THEN '0' ELSE pv END AS prev, CASE WHEN log % 5 = 3 AND line = 1 THEN NULL ELSE h END AS hash FROM l1),
l3 AS (SELECT *, coalesce(lag(hash) OVER w, repeat('0', 64)) AS want, coalesce(lag(seq) OVER w, 0) AS ps FROM l2 WHERE hash IS NOT NULL WINDOW w AS (PARTITION BY log ORDER BY line)),
bad AS (SELECT log, line, CASE WHEN prev <> want THEN 'previous-hash link broken' WHEN seq <> ps + 1 THEN 'sequence gap' WHEN sha256(body) <> hash THEN 'content does not match its hash' END AS reason FROM l3)"""


@query("log_chain_verification", f"""WITH {_LOGS} SELECT log, entries, legacy, first_bad IS NULL AS ok, first_bad, reason FROM (SELECT log, count(*) AS entries, count(*) - count(hash) AS legacy FROM l2 GROUP BY ALL) AS n
  LEFT JOIN (SELECT log, min(line) AS first_bad, arg_min(reason, line) AS reason FROM bad WHERE reason IS NOT NULL GROUP BY ALL) AS b USING (log)""")
def log_chain_verification(spark: SparkSession, sf: str) -> DataFrame:
    """FLD-06 and WIN-20."""
    return tx.verify_chain(_logs(spark, sf))


@query("log_entries_matching", "SELECT conv_id, turn, role FROM conversations WHERE role = 'user' AND contains(lower(text), 'th')")
def log_entries_matching(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-04: all entries of one actor containing a text."""
    return spark.read.parquet(f"{sf}/conversations.parquet").filter((c("role") == "user") & F.lower("text").contains("th")).select("conv_id", "turn", "role")


@query("log_entries_filtered", "SELECT conv_id, turn, role FROM conversations WHERE role = 'user' AND contains(lower(text), 'th') ORDER BY turn DESC, conv_id LIMIT 500")
def log_entries_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-04 and PRJ-07: entries of one actor containing a text, newest first."""
    t = spark.read.parquet(f"{sf}/conversations.parquet").filter((c("role") == "user") & F.lower("text").contains("th"))
    return t.orderBy(F.desc("turn"), "conv_id").limit(500).select("conv_id", "turn", "role")


# ---- catalogues


@query("catalogue_reconcile", """WITH o AS (SELECT doc_id AS id, sha256(lang || source) AS h FROM documents), n AS (SELECT doc_id + 100 AS id, sha256(lang || source) AS h FROM documents)
  SELECT * FROM (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'changed' END AS change FROM o FULL OUTER JOIN n ON o.id = n.id) AS q WHERE change IS NOT NULL""")
def catalogue_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """SET-03: two states of one catalogue, the second shifted by a hundred ids."""
    d = _docs(spark, sf).select(c("doc_id").alias("id"), F.sha2(F.concat("lang", "source"), 256).alias("sha256"))
    return cat.reconcile(d, d.withColumn("id", c("id") + 100))


@query("catalogue_search", "SELECT page_id AS id FROM pages WHERE contains(lower(concat_ws(' ', CAST(page_id AS VARCHAR), url)), 'example.com') AND page_id * 60 >= 600")
def catalogue_search(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-06."""
    p = spark.read.parquet(f"{sf}/pages.parquet").select(c("page_id").alias("id"), c("url").alias("title"), (c("page_id") * 60).alias("modified_ts"))
    return cat.search(p, text="example.com", since_ts=600).select("id")


_PATH = "concat(p_name, '/', p_type, '/file', p_partkey % 50, CASE p_size % 13 WHEN 0 THEN '.glb' WHEN 1 THEN '.PNG' WHEN 2 THEN '.zip' WHEN 3 THEN '.pdf' WHEN 4 THEN '.stl' WHEN 5 THEN '.7z.001' WHEN 6 THEN '.max' WHEN 7 THEN '.exr' WHEN 8 THEN '.tgz' WHEN 9 THEN '.json' WHEN 10 THEN '' WHEN 11 THEN '.lws' ELSE '.bin' END)"
_KIND = "CASE WHEN regexp_full_match(e, '[0-9]{3}') THEN 'archive' WHEN e IN ('glb', 'gltf', 'stl', 'obj', 'fbx', 'blend', '3ds', 'lwo', 'lws', 'dae', 'usdz', 'ma', 'mb', 'max') THEN 'model' WHEN e IN ('png', 'jpg', 'jpeg', 'webp', 'tif', 'tiff', 'bmp', 'exr', 'hdr', 'gif') THEN 'image' WHEN e IN ('7z', 'zip', 'rar', 'gz', 'tgz', 'tar') THEN 'archive' WHEN e IN ('pdf', 'txt', 'md', 'json', 'csv') THEN 'doc' ELSE 'other' END"
_AS = f"ast AS (SELECT *, {_KIND} AS kind FROM (SELECT p_name AS subject, p_type AS category, p_size * 1000 AS bytes, {_PATH} AS path, lower(regexp_extract({_PATH}, '\\.([^./]*)$', 1)) AS e FROM part) AS q)"


def _assets(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/part.parquet")
    path = F.expr("concat(p_name, '/', p_type, '/file', p_partkey % 50, CASE p_size % 13 WHEN 0 THEN '.glb' WHEN 1 THEN '.PNG' WHEN 2 THEN '.zip' WHEN 3 THEN '.pdf' WHEN 4 THEN '.stl' WHEN 5 THEN '.7z.001' WHEN 6 THEN '.max' WHEN 7 THEN '.exr' WHEN 8 THEN '.tgz' WHEN 9 THEN '.json' WHEN 10 THEN '' WHEN 11 THEN '.lws' ELSE '.bin' END)")
    return p.select(c("p_name").alias("subject"), c("p_type").alias("category"), (c("p_size") * 1000).alias("bytes"), path.alias("path")).withColumn("kind", tx.asset_kind(c("path")))


@query("asset_kinds", f"WITH {_AS} SELECT kind, category, count(*) AS assets, CAST(sum(bytes) AS BIGINT) AS bytes FROM ast GROUP BY ALL")
def asset_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-15 and AGG-23."""
    return _assets(spark, sf).groupBy("kind", "category").agg(F.count(F.lit(1)).alias("assets"), F.sum("bytes").alias("bytes"))


@query("asset_coverage", f"WITH {_AS} SELECT subject, count(*) FILTER (kind = 'model') AS model, count(*) FILTER (kind = 'image') AS image, count(*) FILTER (kind = 'model') > 0 AND count(*) FILTER (kind = 'image') > 0 AS model_with_preview FROM ast GROUP BY ALL")
def asset_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-23 by subject."""
    a = _assets(spark, sf).groupBy("subject").agg(F.count_if(c("kind") == "model").alias("model"), F.count_if(c("kind") == "image").alias("image"))
    return a.withColumn("model_with_preview", (c("model") > 0) & (c("image") > 0))


@query("asset_filter", f"WITH {_AS} SELECT path, bytes FROM ast WHERE kind = 'model' AND regexp_matches(subject, '(?i)^RED') AND bytes <= 30000")
def asset_filter(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-05."""
    return _assets(spark, sf).filter((c("kind") == "model") & c("subject").rlike("(?i)^RED") & (c("bytes") <= 30000)).select("path", "bytes")


_PRED = "CASE WHEN d.n_chars % 3 = 0 THEN 1 - l.quality ELSE l.quality END"


@query("classifier_report", f"""WITH pr AS (SELECT l.quality AS truth, {_PRED} AS pred FROM labels AS l JOIN documents AS d USING (doc_id)), lb AS (SELECT DISTINCT unnest([truth, pred]) AS label FROM pr)
  SELECT *, round(correct / nullif(predicted, 0), 4) AS precision, round(correct / nullif(support, 0), 4) AS recall FROM (SELECT label, (SELECT count(*) FROM pr WHERE truth = label) AS support, (SELECT count(*) FROM pr WHERE pred = label) AS predicted, (SELECT count(*) FROM pr WHERE truth = label AND pred = label) AS correct FROM lb) AS q""")
def classifier_report(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-29."""
    l = spark.read.parquet(f"{sf}/labels.parquet").join(_docs(spark, sf).select("doc_id", "n_chars"), "doc_id")
    return tx.classifier_report(l.select(c("quality").alias("truth"), F.when(c("n_chars") % 3 == 0, 1 - c("quality")).otherwise(c("quality")).alias("pred")))


@query("classifier_confusion", f"""WITH pr AS (SELECT l.quality AS truth, {_PRED} AS pred FROM labels AS l JOIN documents AS d USING (doc_id))
  SELECT truth || '->' || pred AS pair, count(*) AS n, round(count(*) / (SELECT count(*) FROM pr WHERE truth IS NOT NULL AND pred IS NOT NULL), 4) AS share, truth = pred AS correct, (SELECT round(avg(CAST(truth = pred AS INT)), 4) FROM pr) AS accuracy FROM pr WHERE truth IS NOT NULL AND pred IS NOT NULL GROUP BY truth, pred""")
def classifier_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-29: confusion rows and accuracy."""
    l = spark.read.parquet(f"{sf}/labels.parquet").join(_docs(spark, sf).select("doc_id", "n_chars"), "doc_id")
    return tx.confusion(l.select(c("quality").alias("truth"), F.when(c("n_chars") % 3 == 0, 1 - c("quality")).otherwise(c("quality")).alias("pred")))


@query("round_robin_sample", """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) AS t FROM documents) AS q ORDER BY t, lang LIMIT 60""")
def round_robin_sample(spark: SparkSession, sf: str) -> DataFrame:
    """ML-14."""
    return tx.round_robin(_docs(spark, sf).select("doc_id", "lang"), "lang", "doc_id", 60, 42)


@query("manifest_verification", """SELECT count(*) AS files, count(*) FILTER (m.h = sha256(d.text)) AS verified, count(*) FILTER (m.h <> sha256(d.text)) AS altered FROM documents AS d JOIN (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'bad' ELSE sha256(text) END AS h FROM documents) AS m USING (doc_id)""")
def manifest_verification(spark: SparkSession, sf: str) -> DataFrame:
    """SCL-26: content hashed again and compared with the manifest."""
    d = _docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("h"))
    m = d.select("doc_id", F.when(c("doc_id") % 50 == 0, "bad").otherwise(c("h")).alias("expected"))
    return d.join(m, "doc_id").agg(F.count(F.lit(1)).alias("files"), F.count_if(c("h") == c("expected")).alias("verified"), F.count_if(c("h") != c("expected")).alias("altered"))
