"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketml.llm import chat_repair, credentials, decontaminate, hard_negatives, language_id, mixing, packing, perplexity, simhash, site_templates, toxicity, warc, whitening
from marketml.llm.common import read


def op1_perplexity(spark, sf_dir):
    """Operator 1 on documents: order 4, 22 hash bits, band width 6."""
    judged = perplexity.judge(read(spark, sf_dir, "documents"), keep=("doc_id",))
    return judged.select(F.col("keep_doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "log_perplexity", F.col("low").alias("band_low"), F.col("high").alias("band_high"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark, sf_dir):
    """Operator 2 on documents: sequences of 2048 tokens; the digest is of the packed ids."""
    packed = packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(), tokens=2048)
    return packed.withColumn("ids_crc32", packing.crc_of_ids("ids")).drop("ids")


def op3_site_templates(spark, sf_dir):
    """Operator 3 on pages."""
    found = site_templates.extract(read(spark, sf_dir, "pages"), keep=("page_id", "url"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_toxicity(spark, sf_dir):
    """Operator 4 on documents; labels of a third of the documents are held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = toxicity.train(docs, read(spark, sf_dir, "labels").where(~held).select("doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "toxicity.score",
                         (F.col("toxicity.score") >= 0.7).cast("int").alias("predicted"), F.col("toxicity.worst").alias("sentences"))


def op5_decontaminate(spark, sf_dir):
    """Operator 5 on documents and benchmark: 13-word windows."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_benchmark(docs, read(spark, sf_dir, "benchmark"), window=13)
    return found.select(
        "doc_id", "found.n_words", decontaminate.hit_words().alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


OP5_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), p AS (
  SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM b, unnest(generate_series(1, greatest(1, len(w) - 12))) AS t(i) WHERE len(w) > 0
), s AS (SELECT DISTINCT size FROM p),
x AS (
  SELECT rid, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM d, s, unnest(generate_series(1, len(w) - size + 1)) AS t(i)
), m AS (SELECT x.rid, x.i, x.size, p.item FROM x JOIN p USING (size, win)),
h AS (
  SELECT rid, count(DISTINCT k) AS n_hit
  FROM (SELECT DISTINCT rid, i, size FROM m) AS q, unnest(generate_series(i, i + size - 1)) AS t(k) GROUP BY rid
), n AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item FROM m WHERE item IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN n USING (rid)
"""


def op6_credentials(spark, sf_dir):
    """Operator 6 on documents: scope of 256 code points."""
    found = credentials.find_credentials(read(spark, sf_dir, "documents"), scope=256)
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), *[number(k).alias(f"n_{name}") for k, name in enumerate(credentials.BASE)],
        F.sha2(credentials.listed(F.col("base")), 256).alias("base_sha256"), credentials.listed(F.col("spans")).alias("spans"))


def op7_chat_repair(spark, sf_dir):
    """Operator 7 on conversations."""
    return chat_repair.repair_roles(read(spark, sf_dir, "conversations"))


def op8_warc(spark, sf_dir):
    """Operator 8 on pages: archives are written to the shared folder and read back."""
    records = warc.read_archives(spark, warc.write_archives(read(spark, sf_dir, "pages"), min_bytes=1000))
    sound = F.when(F.col("sound"), F.col("payload_digest"))  # null, had the payload read not the recorded digest
    return records.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", sound.alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP8_SQL = """
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN again AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM (
  SELECT page_id, html, max(page_id) OVER w AS last, octet_length(encode(html)) >= 1000 AND count(*) OVER w > 1 AS again
  FROM (SELECT page_id, coalesce(html, '') AS html FROM pages) AS p WINDOW w AS (PARTITION BY html)
) AS q
"""


def op9_simhash(spark, sf_dir):
    """Operator 9 on documents: 4-word shingles, at most 4 bits."""
    docs = simhash.assign_components(read(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return docs.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_language_id(spark, sf_dir):
    """Operator 10 on pages; the text model learns from documents."""
    return language_id.identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents").select("text", "lang"))


def op11_whitening(spark, sf_dir):
    """Operator 11 on embeddings: 16 components of whole numbers floor(64 c) + 1000000."""
    done = whitening.whiten(read(spark, sf_dir, "embeddings"), "embedding", keep=("vec_id",), want=16, scale=64, shift=1_000_000)
    each = done.select("vec_id", "whitening", F.explode("whitening.components").alias("c"))
    return each.select("vec_id", "c.component", "whitening.n", "whitening.deviation", "c.whitened", "c.explained", "whitening.identity_error")


def op12_mixing(spark, sf_dir):
    """Operator 12 on documents: weights 1, 2, 3 over the sources, blocks of 64 words, shards of 4096 slots."""
    mix = mixing.mix_sources(read(spark, sf_dir, "documents"), keep=("doc_id",), weights=(1, 2, 3), limit=3)
    return mix.taken().select("keep.doc_id", "size", "source_size", "target", "taken")


def op13_hard_negatives(spark, sf_dir):
    """Operator 13 on embeddings: anchors are ids divisible by 100, ids divisible by 7 move to the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label, positives=5, negatives=5, low=80, scale=256)


OP13_SQL = """
WITH r AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(c AS DOUBLE)) FOR c IN embedding] AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
), s AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, CAST(list_dot_product(a.x, r.x) AS BIGINT) AS score
  FROM r AS a JOIN r ON a.rid <> r.rid WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) AS k FROM s WHERE same) WHERE k <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.k ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

QUERIES = {
    "op1_perplexity": op1_perplexity, "op2_packing": op2_packing,
    "op3_site_templates": op3_site_templates, "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate, "op6_credentials": op6_credentials, "op7_chat_repair": op7_chat_repair, "op8_warc": op8_warc,
    "op9_simhash": op9_simhash, "op10_language_id": op10_language_id, "op11_whitening": op11_whitening, "op12_mixing": op12_mixing,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL: dict[str, str] = {"op5_decontaminate": OP5_SQL, "op8_warc": OP8_SQL, "op13_hard_negatives": OP13_SQL}
