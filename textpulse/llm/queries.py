"""The registered queries of the operators: thin digests of their results over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.llm import codes, decontaminate, jaccard, langid, mixing, negatives, pii, quality, records, rollups, suffixes, urlfilter, warc
from textpulse.llm.tables import table
from textpulse.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_pii(spark, folder):
    found = pii.find_pii(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *(pii.count_kind(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")),
        F.sha2(pii.listed(base_only=True), 256).alias("base_sha256"), pii.listed().alias("spans"))


@query
def op2_jaccard(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return jaccard.similar_groups(docs, n=3, share=(90, 100))


@query
def op3_language(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


@query
def op4_warc(spark, folder):
    """Write, read back, and complete revisits from the responses they name."""
    path = shared_dir(spark, "llm-warc")
    warc.write(warc.resolve(warc.headers(table(spark, folder, "pages"))), path)
    return warc.originals(warc.read(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_mixing(spark, folder):
    """Weights halfway, by their entropy, from the plain shares to equal ones; nothing is left out, scarcer sources repeat in part."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, block_tokens=1 << 13)
    return mixed.select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), "passes", "copies", "block", "place")


@query
def op6_token_counts(spark, folder):
    """Load all documents, delete toxic ones, revise poor ones to their distinct lines, deliver the deletes again."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    labels = table(spark, folder, "labels")
    rollup = rollups.Rollup(spark, shared_dir(spark, "llm-rollup"))
    ledger = rollups.counted(docs)
    rollup.commit("load", ledger)
    toxic = labels.where("toxic = 1").select("doc_id")
    deletes = rollups.negated(ledger.join(toxic, "doc_id", "left_semi"))
    rollup.commit("toxic", deletes)
    poor = labels.where("quality = 0 AND toxic = 0").select("doc_id")
    revised = rollups.counted(docs.withColumn("text", F.array_join(F.array_distinct(F.split("text", "\n", -1)), "\n")))
    changes = rollups.negated(ledger).unionByName(revised)  # counts meet the labels, texts stay where they are
    rollup.commit("poor", changes.join(poor, "doc_id", "left_semi"))
    rollup.commit("toxic", deletes)
    return rollup.totals().select("source", "lang", "version", "n_docs", "n_tokens")


@query
def op7_urls(spark, folder):
    judged = urlfilter.judge(table(spark, folder, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


@query
def op8_decontaminate(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.find_benchmark(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        decontaminate.items_digest().alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op9_suffixes(spark, folder):
    cut = suffixes.without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op10_quality(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return quality.judge(docs).select("doc_id", *quality.COUNTS, "base_failed", "kept", "char_distance", "word_distance")


@query
def op11_negatives(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", F.when(
        F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return negatives.mine(rows, F.col("id") % 100 == 0)


@query
def op12_codes(spark, folder):
    coded, books = codes.coded(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))
    return coded.select("vec_id", codes.hex_code(F.col("_code")).alias("code"), F.col("_error").alias("error"),
                        F.col("_label_error").alias("label_error"), F.lit(codes.digest(books)).alias("codebooks_sha256"))


@query
def op13_records(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return records.round_trip(docs, shared_dir(spark, "llm-records"), TOKENIZER, end_id=2)


SQL["op4_warc"] = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    h AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
    g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM h)
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN original END AS refers_to
    FROM g"""

SQL["op6_token_counts"] = r"""
    WITH d AS (SELECT d.doc_id, source, lang, CASE WHEN l.quality = 0 THEN (
            SELECT string_agg(line, chr(10) ORDER BY first) FROM (
                SELECT line, min(i) AS first FROM (SELECT unnest(str_split(text, chr(10))) AS line,
                    generate_subscripts(str_split(text, chr(10)), 1) AS i) GROUP BY line)) ELSE text END AS text
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(l.toxic, 0) <> 1),
    c AS (SELECT source, lang, 'space-1' AS version, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM d
        UNION ALL SELECT source, lang, 'word-1', len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')) FROM d)
    SELECT source, lang, version, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM c GROUP BY ALL"""

SQL["op8_decontaminate"] = r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    sized AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
    items AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
        FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
    starts AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT DISTINCT k FROM sized) WHERE len(w) >= k),
    hits AS (SELECT doc_id, i, s.k, item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM starts) s
        JOIN items ON items.win = s.win AND items.k = s.k),
    hit_words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM hits) GROUP BY doc_id),
    hit_items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM w LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""

SQL["op2_jaccard"] = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
    SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.b) AS component_id
    FROM w LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = w.doc_id GROUP BY ALL"""

SQL["op11_negatives"] = """
    WITH k AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM k),
    s AS (SELECT a.vec_id AS anchor, a.label AS own, b.vec_id AS id, b.label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor, id, score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
    n AS (SELECT p.anchor, p.id AS positive, p.score AS ps, s.id, s.score,
        row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS rank FROM p JOIN s ON s.anchor = p.anchor
        AND s.label <> s.own AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
    SELECT anchor AS anchor_id, positive AS positive_id, CAST(rank AS INTEGER) AS rank, id AS negative_id, ps AS positive_score,
        score AS negative_score FROM n WHERE rank <= 10"""


def _codes_sql() -> str:
    """Codebook, distances and assignment spelled out as rows by (vector, part, position, entry)."""
    steps = ["""k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             """x AS (SELECT vec_id, (i - 1) // (n // 16) AS part, (i - 1) % (n // 16) AS pos, x FROM (SELECT vec_id, len(v) AS n,
        generate_subscripts(v, 1) AS i, unnest(v) AS x FROM k))""",
             """b0 AS (SELECT part, entry, pos, x AS c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k
        WHERE vec_id IS NOT NULL ORDER BY vec_id LIMIT 64) USING (vec_id))"""]
    for r in range(3):
        steps.append(f"""a{r} AS (SELECT vec_id, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (SELECT vec_id, x.part, entry,
        CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN b{r} ON b{r}.part = x.part AND b{r}.pos = x.pos GROUP BY ALL) GROUP BY vec_id, part)""")
        if r < 2:
            steps.append(f"""b{r + 1} AS (SELECT b.part, b.entry, b.pos, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN (SELECT part, entry, pos,
        CAST(floor(sum(x) / count(*)) AS BIGINT) AS c FROM x JOIN a{r} USING (vec_id, part) GROUP BY ALL) m
        ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)""")
    return f"""WITH {", ".join(f"{s.split(' AS ', 1)[0]} AS MATERIALIZED {s.split(' AS ', 1)[1]}" for s in steps)},
    o AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 JOIN k USING (vec_id)
        GROUP BY ALL)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b2) AS codebooks_sha256 FROM o"""


SQL["op12_codes"] = _codes_sql()
