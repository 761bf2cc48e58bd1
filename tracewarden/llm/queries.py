"""One query per operator, with production parameters, over the whole of its table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import ann, decontaminate, divergence, fim, langid, lines, lm, mixing, sharding, simhash, tokenfiles, tokens, warc
from tracewarden.llm.common import table
from tracewarden.llm.registry import query
from tracewarden.session import cut_lineage, shared_folder


@query("op1_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits in every document: a passage replaced by the text's beginning, one deleted, the source appended."""
    docs = table(spark, sf_dir, "documents")
    length = F.length("text")
    place = lambda start, stop, new: F.struct(start.alias("start"), stop.alias("stop"), new.alias("replacement"))
    third, half = F.floor(length / 3), F.floor(length / 2)
    script = F.array(
        place(third, third + 17, F.substring("text", 1, 23)), place(half, half + 9, F.lit("")),
        place(length.cast("long"), length.cast("long"), F.concat(F.lit(" "), F.col("source"))),
    )
    edits = docs.select("doc_id", F.explode(script).alias("e")).select("doc_id", "e.*")
    trees = cut_lineage(tokens.build_trees(docs))
    edited = tokens.apply_edits(docs, trees, edits)
    return edited.select(
        "doc_id", "tokens_before", "tokens_after", F.get("n_chars", F.lit(1)).alias("chars_after"), "chars_encoded", "leaves_encoded",
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )


@query("op2_lm_scores")
def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


@query(
    "op3_warc_revisits",
    """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
       m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
       SELECT page_id, payload_bytes, payload_digest,
              CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
              CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
       FROM m""",
)
def warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    warc.write_archives(warc.resolve_revisits(warc.from_pages(table(spark, sf_dir, "pages"))), path)
    records = cut_lineage(warc.read_archives(spark, path, with_payload=False).drop("payload"))
    return warc.referred_keys(records).select(
        F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query("op4_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=64, max_distance=4)
    return found.withColumn("fingerprint", F.lower(F.hex("fingerprint")))


@query("op5_sharding")
def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op6_benchmark_decontamination")
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op8_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.held_out(docs).filter("not held_out"))
    found = langid.held_out(langid.identify(docs, model))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query("op9_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.octet_length("text").alias("bytes_left"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


@query(
    "op10_source_mixing",
    f"""WITH d AS (SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, CAST(source_size AS DOUBLE) * 3 AS cap FROM s),
        r AS (SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER before, 0))
                      / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS try
              FROM w WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT try AS level FROM r WHERE try <= cap / w ORDER BY cap / w, try LIMIT 1),
        t AS (SELECT source, source_size, coalesce(least(cap, w * (SELECT level FROM l)), cap) AS target FROM w),
        n AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
                     row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id % {mixing.PORTIONS}, d.doc_id) AS k
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST(floor(rate * k + {mixing.offset_of(17)}) - floor(rate * (k - 1) + {mixing.offset_of(17)}) AS BIGINT) * size AS taken
        FROM n""",
)
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.systematic_copies(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query(
    "op11_fill_in_middle",
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                      sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        k AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                          WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
        s AS (SELECT *, coalesce(array_to_string(u[1:least(a, b)], ''), '') AS p, coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS m,
                     coalesce(array_to_string(u[greatest(a, b) + 1:], ''), '') AS x FROM k)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM s""",
)
def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = cut_lineage(fim.store_frames(table(spark, sf_dir, "documents")))
    return fim.digests(fim.fill_in_middle(stored, seed=7, fim_percent=100, spm_percent=50))


@query(
    "op12_source_divergence",
    r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        kept AS (SELECT lang, item FROM (SELECT lang, unnest(list_distinct(terms)) AS item FROM d) GROUP BY ALL HAVING count(*) >= 30),
        v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY lang),
        c AS (SELECT lang, source, item, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS item FROM d) JOIN kept USING (lang, item) GROUP BY ALL),
        g AS (SELECT * FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang)
              LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source)),
        p AS (SELECT g.lang, g.source, kept.item, coalesce(n, 0) AS n, 1 + 1000000000 * CAST(coalesce(n, 0) + 5 AS HUGEINT) // (coalesce(total, 0) + 5 * v) AS p
              FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.item = kept.item),
        l AS (SELECT lang, item, 1 + 1000000000 * CAST(n + 5 AS HUGEINT) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
              FROM (SELECT lang, item, sum(n) AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
        term AS (SELECT lang, source, 'term' AS part, item, p - q AS value FROM p JOIN l USING (lang, item) WHERE n > 0 AND p > q),
        pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
                 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                 LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.item = y.item GROUP BY ALL) s
                   ON s.lang = a.lang AND s.source = a.source AND s.item = b.source)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM term UNION ALL FROM pair))
        WHERE part = 'pair' OR rank <= 50""",
)
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), min_docs=30, prior=5, top=50)


@query("op13_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/ids-{uuid.uuid4().hex}"
    tokenfiles.write_shards(docs, path, vocabulary=public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    tokenfiles.write_index(spark, path)
    return tokenfiles.fetch(spark, tokenfiles.lookup(spark, docs, path), path, with_ids=False)
