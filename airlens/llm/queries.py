"""The registered queries of this subpackage over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from airlens.llm import compression_quality, credentials, kneser_ney, lsh_forest, preferences, raking, rans, sharding, spanning_tree, spelling, suffix_matches, tile_products, url_rules
from airlens.llm.shared import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
c = F.col


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


# op1 ------------------------------------------------------------------------------------------------------------------

SHARDS = 8
#: size starts at 64 bytes, so that the 32 steps of half an octave reach 4 MB
DIMENSIONS = [sharding.Dimension("source"), sharding.Dimension("lang"), sharding.Dimension("size", "log", 2, 64.0)]
TEXT_DIMENSIONS = [*DIMENSIONS[:2], sharding.Dimension("size", "log", 2, 64.0, "octet_length(row.text)")]


@query
def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 8 runs of the Hilbert order of source, language and size; law: rows."""
    d = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    d = d.select("doc_id", "source", "lang", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32("text").alias("text_crc32"))
    s = sharding.hilbert_shards(d, DIMENSIONS, SHARDS)
    return s.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


# op2 ------------------------------------------------------------------------------------------------------------------


@query
def op2_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pair per conversation: chosen as it is; rejected answers last with its first reply again, or not at all if
    there is only one."""
    t = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").filter("conv_id is not null")
    said = c("role") == "assistant"
    all_turns = W.partitionBy("conv_id")
    t = t.withColumn("last", F.max(F.when(said, c("turn"))).over(all_turns)).withColumn("opening", F.min(F.when(said, F.struct("turn", "text"))).over(all_turns))
    t = t.withColumn("side", F.explode(F.array(F.lit("chosen"), F.lit("rejected"))))
    stale = (c("side") == "rejected") & said & (c("turn") == c("last"))
    t = t.filter(~F.coalesce(stale & (c("opening.turn") == c("last")), F.lit(False)))
    t = t.withColumn("text", F.when(stale, c("opening.text")).otherwise(c("text")))
    p = preferences.preference_pairs(t.select(c("conv_id").alias("pair_id"), "side", "turn", "role", "text"))
    out = [c("pair_id"), c("prompt_turns"), c("prompt")]
    for s in ("chosen", "rejected"):
        out += [F.array_join(c(s)["text"], "").alias(s), F.array_join(F.transform(c(s)["loss"], lambda x: F.when(x, "1").otherwise("0")), "").alias(f"{s}_loss")]
        spans = F.transform(F.filter(c(s), lambda x: x["loss"]), lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))
        out.append(F.array_join(spans, ",").alias(f"{s}_spans"))
    return p.select(*out)


SQL["op2_preference_pairs"] = """
WITH c AS (SELECT conv_id, turn, role, text,
    max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last_turn,
    min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS first_turn,
    min(CASE WHEN role = 'assistant' THEN struct_pack(turn := turn, text := text) END) OVER (PARTITION BY conv_id).text AS first_text
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (
  SELECT conv_id, 'chosen' AS side, turn, role, text FROM c
  UNION ALL
  SELECT conv_id, 'rejected', turn, role, CASE WHEN role = 'assistant' AND turn = last_turn THEN first_text ELSE text END FROM c
  WHERE NOT coalesce(role = 'assistant' AND turn = last_turn AND first_turn = last_turn, false)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn, role, text) AS pos FROM s),
p AS (SELECT conv_id, pos, count(*) FILTER (side = 'chosen') AS a, count(*) FILTER (side = 'rejected') AS b,
    count(DISTINCT coalesce(role, '\x01') || chr(2) || coalesce(text, '\x01')) AS kinds FROM n GROUP BY conv_id, pos),
l AS (SELECT conv_id, coalesce(min(CASE WHEN a = 0 OR b = 0 OR kinds > 1 THEN pos END) - 1, max(pos)) AS k FROM p GROUP BY conv_id),
r AS (SELECT n.*, l.k, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS shown,
    CASE WHEN role = 'assistant' THEN '1' ELSE '0' END AS loss, length('<|' || coalesce(role, '') || '|>' || chr(10)) AS head FROM n JOIN l USING (conv_id)),
q AS (SELECT *, sum(length(shown)) OVER (PARTITION BY conv_id, side, pos > k ORDER BY pos) AS upto FROM r),
w AS (SELECT *, CASE WHEN loss = '1' THEN (upto - length(shown) + head) || ':' || upto END AS span FROM q)
SELECT conv_id AS pair_id, CAST(any_value(k) AS INTEGER) AS prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (side = 'chosen' AND pos <= k), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (side = 'chosen' AND pos > k), '') AS chosen,
  coalesce(string_agg(loss, '' ORDER BY pos) FILTER (side = 'chosen' AND pos > k), '') AS chosen_loss,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (side = 'rejected' AND pos > k), '') AS rejected,
  coalesce(string_agg(loss, '' ORDER BY pos) FILTER (side = 'rejected' AND pos > k), '') AS rejected_loss,
  coalesce(string_agg(span, ',' ORDER BY pos) FILTER (side = 'chosen' AND pos > k), '') AS chosen_spans,
  coalesce(string_agg(span, ',' ORDER BY pos) FILTER (side = 'rejected' AND pos > k), '') AS rejected_spans
FROM w GROUP BY conv_id"""

# op3 ------------------------------------------------------------------------------------------------------------------

ACCEPT = 0.7


def fold(key: str, n: int):
    return F.pmod(F.crc32(c(key).cast("string").cast("binary")), F.lit(n))


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> compression_quality.Model:
    """Fitted on the labels outside the held-out quarter."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return compression_quality.fit(docs, labels.filter(fold("doc_id", 4) != 2))


@query
def op3_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    s = compression_quality.scored(docs, quality_model(spark, sf_dir, docs), keep=["doc_id"])
    return s.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (c("score") >= ACCEPT).cast("int").alias("predicted"))


# op4 ------------------------------------------------------------------------------------------------------------------

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query
def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the five rules."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judged(table(spark, sf_dir, "pages", "page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


SQL["op4_url_rules"] = f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {", ".join(map(str, RULES))}),
a AS (SELECT row_number() OVER () AS id, page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS after FROM pages),
h AS (SELECT id, page_id, translate(regexp_extract(after, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(regexp_replace(after, '^[^/?#]*', ''), '^[^?#]*') AS path FROM a),
m AS (SELECT h.*, r_host || r_path AS rule, r_verdict, row_number() OVER (PARTITION BY id ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) AS n
  FROM h LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM m WHERE n = 1"""

# op5 ------------------------------------------------------------------------------------------------------------------


@query
def op5_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share four fifths of their five-word shingles."""
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


# op6 ------------------------------------------------------------------------------------------------------------------

#: shares of sources, languages and topics are taken to these powers: the largest source weighs less
POWERS = {"source": 0.7, "lang": 0.9, "topic": 0.9}
#: share of the tokens that the draw keeps, whatever the size and the rarest cell
KEEP = 0.5


def topic(text: str = "text"):
    """What a text is about by its marks: license terms, contacts, secrets, or prose by length."""
    t = F.coalesce(c(text), F.lit(""))
    n = raking.token_count(t)
    return F.when(t.contains("License"), "license").when(t.contains("@"), "contact").when(n < 50, "note").when(n < 1000, "prose").otherwise("long")


def mix(docs: DataFrame, text: str = "text", report: dict[str, float] | None = None, error: str | None = None) -> DataFrame:
    return raking.mixed(docs, {"source": c("source"), "lang": c("lang"), "topic": topic(text)}, raking.token_count(c(text)), POWERS, keep=KEEP, report=report, error=error)


@query
def op6_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and fate when tokens are raked to source, language and topic; the largest margin error left."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    return mix(docs, error="margin_error").select("doc_id", "source", "lang", topic().alias("topic"), "tokens", "weight", "probability", "drawn", "margin_error")


# op7 ------------------------------------------------------------------------------------------------------------------


@query
def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of every document under a model of nine tenths of them."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("held_out", F.coalesce(fold("doc_id", 10) == 0, F.lit(False)))
    model = kneser_ney.fit(spark, docs.filter("not held_out"))
    s = kneser_ney.scored(docs, model, keep=["doc_id", "held_out"])
    return s.withColumn("train_tokens", F.lit(model.tokens).cast("long"))


# op8 ------------------------------------------------------------------------------------------------------------------


@query
def op8_tile_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a cosine of 0.95 or more, all against all."""
    v = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return tile_products.near_duplicates(v).select("vec_id", "n_links", "component_id", "kept")


SQL["op8_tile_products"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN m ON m.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""

# op9 ------------------------------------------------------------------------------------------------------------------


@query
def op9_suffix_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = suffix_matches.leaks(spark, table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), keep=["doc_id"])
    ids = c("leak.item_ids")
    longest = F.coalesce(F.array_max(c("leak.matches")["words"]), F.lit(0).cast("long"))
    return found.select("doc_id", c("leak.words").alias("n_words"), c("leak.hit").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (c("leak.hit") > 0).alias("contaminated"), longest.alias("longest_match"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
SQL["op9_suffix_matches"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT i, item_id, q, least(len(w), 10) AS n, list_slice(w, q, q + least(len(w), 10) - 1) AS k FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(q) WHERE len(w) > 0),
dw AS (SELECT r, p, n, list_slice(w, p, p + n - 1) AS k FROM d, (SELECT DISTINCT n FROM bw) AS ns, unnest(range(1, len(w) - n + 2)) AS t(p) WHERE len(w) >= n),
m AS (SELECT r, p, n, i, item_id, q FROM dw JOIN bw USING (n, k)),
hit AS (SELECT r, count(DISTINCT p + o) AS n_hit FROM (SELECT DISTINCT r, p, n FROM m) AS x, unnest(range(n)) AS t(o) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM m WHERE item_id IS NOT NULL) AS x GROUP BY r),
runs AS (SELECT r, count(*) + n - 1 AS l FROM (SELECT r, i, n, p - q AS dg, p - row_number() OVER (PARTITION BY r, i, n, p - q ORDER BY p) AS g FROM m) AS x GROUP BY r, i, n, dg, g),
lo AS (SELECT r, max(l) AS longest FROM runs GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0) AS longest_match
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r) LEFT JOIN lo USING (r)"""

# op10 -----------------------------------------------------------------------------------------------------------------


@query
def op10_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text, and weak parts of credentials near their complements."""
    s = credentials.secret_spans(table(spark, sf_dir, "documents", "doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return s.select("doc_id", *[count(k[0]) for k in credentials.STRONG], F.sha2(credentials.span_list(c("secrets"), True), 256).alias("base_sha256"), credentials.span_list(c("secrets")).alias("spans"))

# op11 -----------------------------------------------------------------------------------------------------------------


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of five letters and three occurrences or more, their near words and the form that each belongs to."""
    counted = spelling.word_counts(table(spark, sf_dir, "documents", "doc_id", "text"), noise=97)
    return spelling.variants(counted.filter((F.char_length("word") >= 5) & (c("n") >= 3)))

# op12 -----------------------------------------------------------------------------------------------------------------


@query
def op12_spanning_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh vector is given the next label."""
    v = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    v = v.withColumn("label", F.when(c("vec_id") % 7 == 0, (c("label").cast("long") + 1) % 10).otherwise(c("label")))
    return spanning_tree.hard_negatives(v, c("vec_id") % 100 == 0, scale=256)


SQL["op12_spanning_tree_negatives"] = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT a, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, id, b) AS k FROM s WHERE same QUALIFY k <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.a, k ORDER BY s.score DESC, s.id, s.b) AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10"""

# op13 -----------------------------------------------------------------------------------------------------------------

TOKENIZER = "word_bpe_49k.json"
END_ID = 1


def tokenizer_json(name: str = TOKENIZER) -> str:
    """A tokenizer file of the machine as text, so that it reaches workers that have no such file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@query
def op13_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to range-coded files and read back."""
    folder = f"{shared_folder(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    rans.write(table(spark, sf_dir, "documents", "doc_id", "text"), folder, tokenizer_json(), END_ID, by_words=True)
    return rans.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
