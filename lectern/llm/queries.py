"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import decontaminate, fill_middle, license_scan, line_dedup, media, mixing, neardup, packing, phrases, quality, secret_scan, sketch, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images: those of this query are pictures of the texts of ``documents``, a row of pixels per word."""
    return media.copies(media.page_pictures(documents(spark, sf_dir))).withColumnRenamed("image_id", "doc_id")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sketch.fingerprints(documents(spark, sf_dir))
    digest = sketch.digest
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest(F.col("sketch")).alias("fingerprint"), digest(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next", "in_next", "distinct_shingles"
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(documents(spark, sf_dir))
    kinds = F.transform("base", lambda s: s["kind"])
    count = {f"n_{k}": (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long") for k in ("assign", "access", "hex")}
    listed = secret_scan.listed
    return out.select("doc_id", *[c.alias(k) for k, c in count.items()], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir))
    return out.select(
        "doc_id", F.size("deleted_lines").cast("long").alias("n_deleted"), F.concat_ws(",", F.col("deleted_lines").cast("array<string>")).alias("deleted_lines"), F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256")
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), packing.public_byte_bpe)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(documents(spark, sf_dir))
    return out.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_middle(documents(spark, sf_dir))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = decontaminate.n_hit(F.col("spans"))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


HEAD = "(SELECT doc_id, text, length(text) AS n, contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS marked, sha256('1:' || doc_id) AS h FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"
NUMBER = "CAST('0x' || substr(h, {0}, 8) AS BIGINT)"
FILL_MIDDLE = f"""WITH drawn AS (SELECT *, {NUMBER.format(1)} % (n + 1) AS c1, {NUMBER.format(9)} % (n + 1) AS c2, n = 0 OR marked OR {NUMBER.format(17)} % 100 >= 90 AS whole, {NUMBER.format(25)} % 100 < 20 AS late FROM {HEAD}),
cut AS (SELECT *, CASE WHEN whole THEN 'plain' WHEN late THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT whole THEN least(c1, c2) END AS a, CASE WHEN NOT whole THEN abs(c1 - c2) END AS m FROM drawn),
parts AS (SELECT *, '<P>' || substr(text, 1, a) AS p, '<M>' || substr(text, a + 1, m) AS mid, '<S>' || substr(text, a + m + 1) AS s FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(a AS BIGINT) AS prefix_chars, CAST(m AS BIGINT) AS middle_chars, sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN p || s || mid ELSE s || p || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM parts"""

LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
GRAMS = " UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(words[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, words, unnest(range(1, len(words) - {k} + 2)) AS i FROM pieces WHERE len(words) >= {k})" for k in range(1, 5))
PHRASES = f"""WITH texts AS (SELECT coalesce(lang, 'und') AS lang, {LOW.format("coalesce(text, '')")} AS text FROM documents),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS words FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM ({GRAMS}) GROUP BY 1, 2, 3 HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM pieces GROUP BY 1),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, k, phrase, a, c, array_to_string(w[1:c], ' ') AS x, array_to_string(w[c + 1:k], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS c FROM cand)),
scored AS (SELECT cuts.lang, cuts.phrase, a, c, fx.f AS l, fy.f AS r, (2000000::HUGEINT * a) // (fx.f::HUGEINT + fy.f) AS score FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = x JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = y),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS nth FROM scored),
inside AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, w, a, i, unnest(range(2, k)) AS j FROM (SELECT lang, w, a, k, unnest(range(1, k)) AS i FROM cand)) WHERE i + j - 1 <= len(w) GROUP BY 1, 2),
ranked AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE nth = 1 AND (longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""

WORDS = "regexp_extract_all(" + LOW + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
DECONTAMINATE = f"""WITH docs AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS words FROM documents),
items AS (SELECT item_id, words, least(len(words), 10) AS size FROM (SELECT item_id, {WORDS.format("coalesce(text, '')")} AS words FROM benchmark) WHERE len(words) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS w FROM (SELECT item_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM items)),
places AS (SELECT doc_id, spot, size, array_to_string(words[spot:spot + size - 1], ' ') AS w FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS spot FROM docs, (SELECT DISTINCT size FROM items))),
met AS (SELECT doc_id, spot, p.size, item_id FROM places p JOIN windows v ON v.size = p.size AND v.w = p.w),
hits AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(spot, spot + size)) AS word FROM (SELECT DISTINCT doc_id, spot, size FROM met)) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM met) GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""


def queries() -> dict:
    own = (
        op1_mix, op2_simhash, op3_toxicity, op4_media, op5_fingerprints, op6_secrets, op7_quality, op8_lines, op9_packing, op10_licenses,
        op11_fill_middle, op12_phrases, op13_decontaminate,
    )
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express, and the pipeline's where it has any; the others are tested against brute force."""
    own = {"op11_fill_middle": FILL_MIDDLE, "op12_phrases": PHRASES, "op13_decontaminate": DECONTAMINATE}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
