"""Registered queries of the operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm import (
    bpe,
    decontaminate,
    exact_dedup,
    fixity,
    hard_negatives,
    line_spread,
    packing,
    passages,
    periodic,
    quality,
    simhash,
    topk,
    url_trees,
)


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def tokenizer_spec(name: str) -> str:
    """A public tokenizer's JSON file, read on the driver; operators take its content and broadcast it."""
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 1024 tokens."""
    return packing.pack_documents(_read(spark, folder, "documents"), tokenizer_spec("byte_bpe_50k.json"))


def op2_weak_label_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality and whether it is kept."""
    judged = quality.judge(_read(spark, folder, "documents"))
    return judged.select("row.doc_id", F.round("quality", 6).alias("quality"), "kept")


def damaged(records: DataFrame) -> DataFrame:
    """A replica with known faults: of every 97 page ids one record has a byte changed, one is lost, one has grown."""
    kind = F.pmod(F.col("page_id"), F.lit(97))
    changed = F.concat(F.lit(b"w"), F.substring("payload", 2, 1 << 30))
    grown = F.concat(F.col("payload"), F.lit(b"\n"))
    payload = F.when(kind == 3, changed).when(kind == 5, grown).otherwise(F.col("payload"))
    return records.where(kind.isNull() | (kind != 4)).withColumn("payload", payload)


def op3_merkle_fixity(spark: SparkSession, folder: str) -> DataFrame:
    """Where a replica of all pages' WARC records differs from the records, found through both trees.

    The table has one copy of each page, so the second replica is made from it
    with known faults; every record of both replicas is hashed.
    """
    pages = _read(spark, folder, "pages")
    payload = fixity.warc_record(F.col("url"), F.col("html"), F.col("page_id"))
    records = fixity.lay_out(pages.select("page_id", payload.alias("payload")))
    found = fixity.audit(fixity.fixity_tree(records), fixity.fixity_tree(damaged(records)))
    named = found.join(records.select("file", "offset", "page_id", "payload"), ["file", "offset"])
    return named.select("page_id", "status", "left_size", "right_size", F.sha2("payload", 256).alias("record_sha256"))


def op4_compact_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Every near-duplicate passage of 50 words or more with its earlier place."""
    found = passages.repeated_passages(_read(spark, folder, "documents"))
    return found.drop("id", "other_id")


def op5_line_spread(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without its cross-site lines."""
    cut = line_spread.cut_spread_lines(_read(spark, folder, "documents"))
    return cut.select("doc_id", "lines", "removed", F.sha2("clean_text", 256).alias("clean_sha256"))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the equal text that stays."""
    return exact_dedup.text_copies(_read(spark, folder, "documents"), exact_dedup.fresh_index(spark), "first")


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its fingerprint and the least document that near fingerprints lead to."""
    found = simhash.near_duplicates(_read(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every document's ids and of the text that they decode to."""
    return bpe.round_trip(_read(spark, folder, "documents"), tokenizer_spec("word_bpe_49k.json"))


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op9_url_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, rule and verdict of every page; the URLs that a rule decides are the labelled ones."""
    return url_trees.filter_urls(_read(spark, folder, "pages"), RULES)


def op10_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The five best of all vectors for every query vector."""
    return topk.top_k(_read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Up to three hard negatives of every anchor's five positives; every seventh label is moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, moved)


def op12_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's words that lie in windows of the benchmark, and the items these come from."""
    found = decontaminate.find(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        "row.doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def with_planted_runs(text: Column, doc_id: Column) -> Column:
    """The text; of every tenth document (by the CRC of its id) its words from some place on repeat with some period."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def rewritten(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i))), " ")

    words = F.filter(F.split(text, periodic.WHITE), lambda w: w != "")
    # The array around the words is there to have them worked out once, not once per word.
    new = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, rewritten(w)).otherwise(F.lit("")))[0]
    return F.when(h % 10 == 0, new).otherwise(text)


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's runs of repeated words, the longest of them, and digests of the runs and of the text without repeats."""
    docs = _read(spark, folder, "documents").select("doc_id", with_planted_runs(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic.find_runs(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = found.select("row.doc_id", "runs", "collapsed", lines.alias("lines"), longest.alias("best"))
    length, start, period = F.col("best.length"), -F.col("best.start"), -F.col("best.period")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"),
        period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("lines", lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


LOWER_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Fixed value: words of the decontamination contract.
ALPHANUMERIC = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_weak_label_quality": op2_weak_label_quality,
    "op3_merkle_fixity": op3_merkle_fixity,
    "op4_compact_windows": op4_compact_windows,
    "op5_line_spread": op5_line_spread,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_simhash": op7_simhash,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_url_trees": op9_url_trees,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_decontaminate": op12_decontaminate,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL: dict[str, str] = {
    "op3_merkle_fixity": """
        WITH records AS (
            SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
                || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
                || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
                || 'Content-Type: text/html' || chr(13) || chr(10)
                || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
                || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS payload
            FROM pages)
        SELECT page_id, CASE page_id % 97 WHEN 4 THEN 'missing' ELSE 'changed' END AS status,
               strlen(payload)::BIGINT AS left_size,
               CASE page_id % 97 WHEN 3 THEN strlen(payload) WHEN 5 THEN strlen(payload) + 1 END::BIGINT AS right_size,
               sha256(payload) AS record_sha256
        FROM records WHERE page_id % 97 IN (3, 4, 5)""",
    "op5_line_spread": f"""
        WITH parts AS (
            SELECT doc_id, coalesce(source, chr(0)) AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
            FROM documents),
        spread AS (
            SELECT trim(line, ' ') AS bare FROM parts WHERE trim(line, ' ') <> '' GROUP BY 1
            HAVING count(DISTINCT site) >= {line_spread.SITES})
        SELECT doc_id, count(*)::BIGINT AS lines, count(bare)::BIGINT AS removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE bare IS NULL), '')) AS clean_sha256
        FROM parts LEFT JOIN spread ON trim(line, ' ') = bare
        GROUP BY doc_id""",
    "op6_exact_dedup": f"""
        WITH texts AS (SELECT doc_id, sha256({LOWER_AZ}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, text_sha256
        FROM texts WINDOW same AS (PARTITION BY text_sha256)""",
    "op10_exact_top_k": """
        WITH weights AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS w
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        terms AS (SELECT vec_id, unnest(w) AS weight, generate_subscripts(w, 1) AS term FROM weights),
        scores AS (
            SELECT q.vec_id AS query_id, c.vec_id, sum(q.weight * c.weight)::BIGINT AS score
            FROM terms q JOIN terms c ON q.term = c.term
            WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
            GROUP BY 1, 2)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
               vec_id, score
        FROM scores
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "op11_hard_negatives": """
        WITH weights AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS w
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        terms AS (SELECT vec_id, label, unnest(w) AS weight, generate_subscripts(w, 1) AS term FROM weights),
        scores AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, sum(a.weight * c.weight)::BIGINT AS score
            FROM terms a JOIN terms c ON a.term = c.term
            WHERE a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
            GROUP BY 1, 2, 3),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        ranked AS (
            SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
                   (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank
            FROM positives JOIN scores USING (anchor_id)
            WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
        SELECT * FROM ranked WHERE rank <= 3""",
    "op12_decontaminate": f"""
        WITH item_words AS (SELECT item_id, regexp_extract_all({LOWER_AZ}, '{ALPHANUMERIC}') AS w FROM benchmark),
        item_windows AS (
            SELECT DISTINCT item_id::VARCHAR AS item, len(g) AS size, g FROM (
                SELECT item_id, unnest(CASE WHEN len(w) < 10 THEN [w]
                    ELSE list_transform(range(1, len(w) - 8), lambda i: w[i : i + 9]) END) AS g
                FROM item_words WHERE len(w) > 0)),
        doc_words AS (SELECT doc_id, regexp_extract_all({LOWER_AZ}, '{ALPHANUMERIC}') AS w FROM documents),
        doc_windows AS (
            SELECT doc_id, size, place, w[place : place + size - 1] AS g FROM (
                SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS place
                FROM doc_words, (SELECT DISTINCT size FROM item_windows))),
        hits AS (SELECT doc_id, place, size, item FROM doc_windows JOIN item_windows USING (size, g)),
        hit_words AS (
            SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(place, place + size)) AS word FROM hits)
            GROUP BY 1),
        hit_items AS (
            SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
        FROM doc_words LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id)""",
}
