"""Equivalent DuckDB SQL for the registered queries, written against the definitions and not against the plans.

Pairs, distances and fills are spelled out here as full grids: the plain form that the Spark operators avoid.
"""

from __future__ import annotations

import re

from textpulse.functions.stopwords import ENGLISH, WITH_EXTRA
from textpulse.plans.recipes import GROUPS, NGRAM_MIN_DF, WORDS
from textpulse.sources.articles import FAILED_MARKER, FAILED_PATTERN
from textpulse.sources.items import URL_PREFIX


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


W3, W2, A2 = r"'[\p{L}\p{N}_]{3,}'", r"'[\p{L}\p{N}_]{2,}'", "'[a-z]{2,}'"
STOP, STOP_EN = _list(WITH_EXTRA), _list(ENGLISH)
N = "(SELECT count(*) FROM documents)"
TITLE = "split_part(text, chr(10), 1)"



def _ngrams(p: str, docs: str) -> dict[str, str]:
    """Counts and vocabulary of one- and two-word terms."""
    return {
        f"{p}uni": f"""SELECT doc_id, grp, pos, term FROM (SELECT doc_id, grp, generate_subscripts(l, 1) AS pos, unnest(l) AS term
            FROM (SELECT doc_id, grp, regexp_extract_all(lower(text), {A2}) AS l FROM {docs})) WHERE term NOT IN ({STOP_EN})""",
        f"{p}ng": f"""SELECT doc_id, grp, term, count(*) AS tf FROM (SELECT doc_id, grp, term FROM {p}uni UNION ALL
            SELECT doc_id, grp, term || ' ' || lead(term) OVER (PARTITION BY doc_id ORDER BY pos) FROM {p}uni)
            WHERE term IS NOT NULL GROUP BY ALL""",
        f"{p}gv": f"""SELECT term, CAST(sum(tf) AS BIGINT) AS cf FROM {p}ng GROUP BY term
            HAVING count(*) >= CAST({NGRAM_MIN_DF} AS DOUBLE) * (SELECT count(*) FROM {docs})""",
        f"{p}gc": f"SELECT doc_id, grp, term, tf FROM {p}ng WHERE term IN (SELECT term FROM {p}gv)",
    }


def _distances(p: str, asked: str, docs: str | None = None, vocab: str | None = None) -> dict[str, str]:
    """Cosine distances of the asked terms and what follows from them.

    The 60 nearest of a term are among its stored pairs, itself, and the first 120 (group, word) pairs at distance 1.
    """
    docs, vocab = docs or (f"{p}d" if p else "d"), vocab or f"{p}gv"
    return {
        f"{p}ask": asked,
        f"{p}gs": f"""SELECT x.grp, x.term, y.term AS other, sum(x.tf * y.tf) AS s FROM {p}gc x JOIN {p}gc y USING (doc_id)
            WHERE x.term IN (SELECT term FROM {p}ask) AND x.term <> y.term GROUP BY x.grp, x.term, y.term""",
        f"{p}gn": f"SELECT grp, term, sqrt(sum(tf * tf)) AS nrm FROM {p}gc GROUP BY ALL",
        f"{p}cos": f"""SELECT g.grp, g.term, g.other, greatest(1 - s / (x.nrm * y.nrm), 0) AS dist FROM {p}gs g
            JOIN {p}gn x ON x.grp = g.grp AND x.term = g.term JOIN {p}gn y ON y.grp = g.grp AND y.term = g.other""",
        f"{p}lead": f"""SELECT grp, word FROM (SELECT DISTINCT grp FROM {docs}) CROSS JOIN (SELECT term AS word FROM {vocab}
            ORDER BY term LIMIT 120) ORDER BY grp, word LIMIT 120""",
        f"{p}near": f"""SELECT term, grp, word, dist FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY dist, grp, word) AS rn
            FROM (SELECT term, grp, word, min(dist) AS dist FROM (
                SELECT term, grp, other AS word, round(dist, 9) AS dist FROM {p}cos
                    QUALIFY row_number() OVER (PARTITION BY term ORDER BY round(dist, 9), grp, other) <= 60
                UNION ALL SELECT term, grp, term, 0 FROM {p}ask CROSS JOIN (SELECT DISTINCT grp FROM {docs})
                UNION ALL SELECT term, grp, word, 1 FROM {p}ask CROSS JOIN {p}lead) GROUP BY term, grp, word)) WHERE rn <= 60""",
        f"{p}retained": f"""SELECT term, grp, word, coalesce(dist, 0) AS dist FROM (SELECT DISTINCT term, grp FROM {p}near)
            JOIN (SELECT DISTINCT term, word FROM {p}near) USING (term) LEFT JOIN {p}near USING (term, grp, word)""",
        f"{p}gd": f"""SELECT a.term, a.grp AS g1, b.grp AS g2, sqrt(sum((a.dist - b.dist) * (a.dist - b.dist))) AS dist
            FROM {p}retained a JOIN {p}retained b USING (term, word) GROUP BY ALL""",
        f"{p}edge": f"SELECT term, grp, word, dist FROM {p}retained WHERE term <> word",
    }


# Shared views. Each may use the ones above it.
VIEWS = {
    "d": """SELECT doc_id, source AS grp, CAST(DATE '2024-01-01' + CAST(doc_id * 7919 % 1009 % 30 AS INTEGER) AS DATE) AS day,
        text FROM documents""",
    "i": f"""SELECT 'v' || doc_id AS item_id, grp AS grp_id,
        CASE WHEN doc_id % 3 <> 0 THEN 'list ' || grp ELSE '' END AS playlist, CAST(day AS TIMESTAMP) AS published_at,
        {TITLE} AS title, substring(text, length({TITLE}) + 2) AS description, '{URL_PREFIX}v' || doc_id AS url FROM d""",
    "dict": """SELECT DISTINCT source AS grp_id, upper(source) AS grp FROM documents
        WHERE source < (SELECT max(source) FROM documents)""",
    "boil": f"SELECT DISTINCT unnest(regexp_extract_all(lower(text), {W3})) AS term FROM benchmark",
    "tok": f"SELECT doc_id, grp, day, unnest(regexp_extract_all(lower(text), {W3})) AS term FROM d",
    "tf": f"""SELECT doc_id, grp, day, term, count(*) AS tf FROM tok
        WHERE term NOT IN ({STOP}) AND term NOT IN (SELECT term FROM boil) GROUP BY ALL""",
    "st": "SELECT grp, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY ALL",
    "st2": f"""SELECT grp, term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, grp, unnest(regexp_extract_all(lower(text), {W2}))
        AS term FROM d) GROUP BY ALL""",
    "v": f"""SELECT term, CAST(sum(df) AS BIGINT) AS df, CAST(sum(cf) AS BIGINT) AS cf FROM st GROUP BY term
        HAVING count(*) FILTER (df >= 5) >= 2 AND sum(df) >= 10 AND sum(df) <= 0.5 * {N}
        ORDER BY sum(cf) DESC, term LIMIT 1000""",
    "f1": "SELECT term FROM v ORDER BY cf DESC, term LIMIT 1",
    "f5": "SELECT term FROM v ORDER BY cf DESC, term LIMIT 5",
    "w": f"""SELECT doc_id, grp, day, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS w FROM (
        SELECT tf.*, tf * (ln((1 + {N}) / (1 + df)) + 1) AS x FROM tf JOIN v USING (term))""",
    "cell": "SELECT day, grp, count(*) AS n_docs FROM d GROUP BY ALL",
    "td": """SELECT day, grp, term, CASE WHEN n_docs IS NOT NULL THEN coalesce(s, 0) / n_docs END AS mean_prop
        FROM (SELECT DISTINCT day FROM cell) CROSS JOIN (SELECT DISTINCT grp FROM cell) CROSS JOIN (SELECT term FROM v)
        LEFT JOIN cell USING (day, grp) LEFT JOIN (SELECT day, grp, term, sum(w) AS s FROM w GROUP BY ALL)
        USING (day, grp, term)""",
    "words": """SELECT day, grp, term AS word, coalesce(mean_prop, 0) AS mean_prop FROM td
        WHERE term IN (SELECT term FROM f5)""",
    "prop": "SELECT grp, word, avg(mean_prop) AS overall_prop FROM words GROUP BY ALL",
    "line": """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS day, r_name AS grp, p_name FROM lineitem
        JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "lw": """SELECT day, grp, term, count(*) AS n FROM (SELECT day, grp, unnest(list_distinct(string_split(p_name, ' ')))
        AS term FROM line) GROUP BY ALL""",
    "m": """SELECT day, grp, term, coalesce(n, 0) / c AS mean_prop FROM (SELECT DISTINCT day FROM line)
        CROSS JOIN (SELECT DISTINCT grp FROM line) CROSS JOIN (SELECT DISTINCT term FROM lw)
        LEFT JOIN (SELECT day, grp, count(*) AS c FROM line GROUP BY ALL) USING (day, grp) LEFT JOIN lw USING (day, grp, term)""",
    "mr": """SELECT day, grp, term, CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY day, grp ORDER BY x DESC NULLS LAST)
        + (count(*) OVER (PARTITION BY day, grp, x) - 1) / 2 END AS rank FROM (
        SELECT day, grp, term, round(avg(nullif(mean_prop, 0)) OVER (PARTITION BY grp, term ORDER BY day
        ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 9) AS x FROM m)""",
    "grid": f"""SELECT day, grp, {', '.join(f"max(mean_prop) FILTER (term = '{w}') AS {w}" for w in WORDS)} FROM m
        WHERE term IN ({_list(WORDS)}) GROUP BY ALL""",
    # correlation
    "size": "SELECT grp, count(*) AS n FROM d GROUP BY grp",
    "mom": """SELECT grp, term, n, sum(w) AS sx, n * sum(w * w) - sum(w) * sum(w) AS ss FROM w JOIN size USING (grp)
        GROUP BY grp, term, n HAVING n * sum(w * w) - sum(w) * sum(w) > 1e-12 * n * sum(w * w)""",
    "pair": """SELECT x.grp, x.term, y.term AS other, sum(x.w * y.w) AS s FROM w x JOIN w y USING (doc_id)
        GROUP BY x.grp, x.term, y.term""",
    "corr": """SELECT x.grp, x.term, o.other, CASE WHEN y.ss IS NULL THEN 0 ELSE greatest(least(
        (x.n * coalesce(p.s, 0) - x.sx * y.sx) / sqrt(x.ss * y.ss), 1), -1) END AS corr
        FROM mom x JOIN (SELECT DISTINCT p.term, q.term AS other FROM mom p JOIN mom q USING (grp)) o ON x.term = o.term
        LEFT JOIN mom y ON y.grp = x.grp AND y.term = o.other
        LEFT JOIN pair p ON p.grp = x.grp AND p.term = x.term AND p.other = o.other""",
    # n-grams: of pages, cosines for all terms (allcos) and the rest for one (g1st), and of short texts (c...), for all terms
    **_ngrams("", "d"),
    "g1st": "SELECT term FROM gv ORDER BY cf DESC, term LIMIT 1",
    **_distances("", "SELECT term FROM g1st"),
    "allcos": """SELECT g.grp, g.term, g.other, greatest(1 - s / (x.nrm * y.nrm), 0) AS dist FROM (
        SELECT x.grp, x.term, y.term AS other, sum(x.tf * y.tf) AS s FROM gc x JOIN gc y USING (doc_id) WHERE x.term <> y.term
        GROUP BY x.grp, x.term, y.term) g JOIN gn x ON x.grp = g.grp AND x.term = g.term JOIN gn y ON y.grp = g.grp AND y.term = g.other""",
    "cd": "SELECT conv_id || '-' || turn AS doc_id, role AS grp, text FROM conversations",
    **_ngrams("c", "cd"),
    **_distances("c", "SELECT term FROM cgv"),
    # documents in which a term is informative
    "ascii": f"""SELECT doc_id, grp, term, count(*) AS tf FROM (SELECT doc_id, grp, unnest(regexp_extract_all(lower(text), {A2}))
        AS term FROM d) GROUP BY ALL""",
    "ls": """SELECT topic_id, source AS grp, CAST(score AS DOUBLE) AS score FROM (SELECT doc_id, 'quality' AS topic_id,
        quality AS score FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) JOIN documents USING (doc_id)""",
    "lg": "SELECT topic_id, grp, count(*) AS n, avg(score) AS mean, var_samp(score) AS var FROM ls GROUP BY ALL",
    "lp": "SELECT topic_id, sum(n) - count(*) AS df, sum((n - 1) * coalesce(var, 0)) AS ss FROM lg GROUP BY topic_id",
    # Tukey's test by quadrature: normal distribution by Simpson's rule, range of k normals on a grid of widths (0.01),
    # read between grid points by cubic interpolation, and mixed over the density of the pooled deviation.
    "es": """SELECT vec_id AS doc_id, CAST(label AS VARCHAR) AS grp, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS topic_id,
        CAST(unnest(embedding) AS DOUBLE) AS score FROM embeddings""",
    "et": "SELECT topic_id, sqrt(sum(score * score)) AS sigma FROM es GROUP BY topic_id",
    "eg": "SELECT topic_id, grp, count(*) AS n, avg(score) AS mean, var_samp(score) AS var FROM es GROUP BY ALL",
    "ep": "SELECT topic_id, sum(n) - count(*) AS df, sum((n - 1) * coalesce(var, 0)) AS ss FROM eg GROUP BY topic_id",
    "kd": """SELECT DISTINCT k, df FROM (SELECT count(*) AS k, sum(n) - count(*) AS df FROM lg GROUP BY topic_id
        UNION ALL SELECT count(*), sum(n) - count(*) FROM eg GROUP BY topic_id)""",
    "phi": """SELECT i, x, d, sum(step) OVER (ORDER BY i) - step AS c FROM (SELECT i, x, exp(-x * x / 2) / sqrt(2 * pi()) AS d,
        (exp(-x * x / 2) + 4 * exp(-(x + 0.5e-2) * (x + 0.5e-2) / 2) + exp(-(x + 1e-2) * (x + 1e-2) / 2)) * 1e-2 / 6 / sqrt(2 * pi()) AS step
        FROM (SELECT i, CAST(i AS DOUBLE) / 100 AS x FROM (SELECT unnest(range(-2900, 851)) AS i)))""",
    "rg": """SELECT k, j, sum(CAST(k AS DOUBLE) * 1e-2 * a.d * pow(a.c - b.c, k - 1)) AS r FROM (SELECT DISTINCT k FROM kd)
        CROSS JOIN (SELECT unnest(range(0, 2003)) AS j) JOIN phi a ON a.i BETWEEN -850 AND 850 JOIN phi b ON b.i = a.i - j GROUP BY k, j""",
    "sd": """SELECT k, df, s, f / sum(f) OVER (PARTITION BY k, df) AS f FROM (SELECT k, df, s, exp((df - 1) * ln(s) - df * s * s / 2
        - (df - 1) * ln(1.0) + df / 2.0) AS f FROM (SELECT k, df, 1 + 9 / sqrt(2.0 * df) * i / 60 AS s FROM kd
        CROSS JOIN (SELECT unnest(range(-60, 61)) AS i)) WHERE s > 0)""",
    "qs": """SELECT DISTINCT k, df, q FROM (SELECT x.topic_id, count(*) OVER (PARTITION BY x.topic_id, x.grp, y.grp) AS o, kk.k, df,
        abs(y.mean - x.mean) / nullif(sqrt(ss / df / 2 * (1 / x.n + 1 / y.n)), 0) AS q FROM lg x JOIN lg y ON x.topic_id = y.topic_id
        AND x.grp < y.grp JOIN lp ON lp.topic_id = x.topic_id JOIN (SELECT topic_id, count(*) AS k FROM lg GROUP BY topic_id) kk
        ON kk.topic_id = x.topic_id) UNION ALL SELECT k, df, CAST(i AS DOUBLE) / 100 FROM kd CROSS JOIN (SELECT unnest(range(1, 1200)) AS i)""",
    "rc": """SELECT k, j, lag(r) OVER w AS r0, r AS r1, lead(r) OVER w AS r2, lead(r, 2) OVER w AS r3 FROM rg WINDOW w AS (PARTITION BY k ORDER BY j)""",
    "tail": """SELECT k, df, q, 1 - sum(f * CASE WHEN q * s >= 20 THEN 1 ELSE -t * (t - 1) * (t - 2) / 6 * r0
        + (t + 1) * (t - 1) * (t - 2) / 2 * r1 - (t + 1) * t * (t - 2) / 2 * r2 + (t + 1) * t * (t - 1) / 6 * r3 END) AS p
        FROM (SELECT k, df, q, s, f, least(greatest(CAST(floor(q * s * 100) AS BIGINT), 1), 2000) AS j,
            q * s * 100 - least(greatest(CAST(floor(q * s * 100) AS BIGINT), 1), 2000) AS t FROM qs JOIN sd USING (k, df)
            WHERE q IS NOT NULL) JOIN rc USING (k, j) GROUP BY k, df, q""",
    # The critical value, by cubic interpolation of q as a function of the tail around 0.05.
    "crit": """SELECT k, df, sum(q * (CASE n WHEN 1 THEN (y - p2) * (y - p3) * (y - p4) / ((p1 - p2) * (p1 - p3) * (p1 - p4))
        WHEN 2 THEN (y - p1) * (y - p3) * (y - p4) / ((p2 - p1) * (p2 - p3) * (p2 - p4))
        WHEN 3 THEN (y - p1) * (y - p2) * (y - p4) / ((p3 - p1) * (p3 - p2) * (p3 - p4))
        ELSE (y - p1) * (y - p2) * (y - p3) / ((p4 - p1) * (p4 - p2) * (p4 - p3)) END)) AS crit FROM (
        SELECT *, 0.5e-1 AS y, max(p) FILTER (n = 1) OVER w AS p1, max(p) FILTER (n = 2) OVER w AS p2, max(p) FILTER (n = 3) OVER w AS p3,
            max(p) FILTER (n = 4) OVER w AS p4 FROM (SELECT k, df, q, p, row_number() OVER (PARTITION BY k, df ORDER BY q) AS n FROM (
            SELECT t.k, t.df, t.q, t.p FROM tail t JOIN (SELECT k, df, max(q) AS q0 FROM tail WHERE p > 0.5e-1
                AND abs(q * 100 - round(q * 100)) < 1e-7 GROUP BY k, df) z ON z.k = t.k AND z.df = t.df
            WHERE abs(t.q * 100 - round(t.q * 100)) < 1e-7 AND t.q > q0 - 0.15e-1 AND t.q < q0 + 0.25e-1))
        WINDOW w AS (PARTITION BY k, df)) GROUP BY k, df""",
    # components out of the groups' weights
    "gt": """SELECT CAST(substring(grp, 4) AS INTEGER) AS topic_id, term, sum(w) AS weight FROM w GROUP BY ALL""",
    "gl": """SELECT topic_id, term, weight, CAST(least(5, count(*) OVER (PARTITION BY topic_id)) - rn + 1 AS INTEGER) AS pos FROM (
        SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY round(weight, 9) DESC, term) AS rn FROM gt) WHERE rn <= 5""",
    "top": """SELECT doc_id, grp, topic_id, score, CAST(rn AS INTEGER) AS pos FROM (SELECT doc_id, grp, topic_id, score * sigma AS score,
        row_number() OVER (PARTITION BY doc_id ORDER BY round(score * sigma, 9) DESC, topic_id) AS rn FROM es JOIN et USING (topic_id))
        WHERE rn <= 10""",
    # vectors of the topics: ascii tokens of the common vocabulary, pruned
    "tv": f"""SELECT term, sum(df) AS df FROM (SELECT grp, term, count(*) AS df FROM ascii WHERE term NOT IN ({STOP_EN}) GROUP BY ALL)
        JOIN size USING (grp) WHERE df >= 2 AND df <= CAST(0.3 AS DOUBLE) * n GROUP BY term
        HAVING count(*) = (SELECT count(DISTINCT source) FROM documents) AND sum(df) >= CAST(0.005 AS DOUBLE) * {N}""",
    "tx": f"""SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM (SELECT doc_id, term,
        tf * (ln((1 + {N}) / (1 + df)) + 1) AS x FROM ascii JOIN tv USING (term))""",
    "tg": "SELECT sum(a.x * b.x) AS s FROM tx a JOIN tx b USING (doc_id) GROUP BY a.term, b.term",
    "lim": "SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 40 AS step FROM events",
}


# The same chain over the documents that three batches leave.
VIEWS["live_d"] = """SELECT d.* FROM d LEFT JOIN labels USING (doc_id)
    WHERE NOT coalesce(quality = 0 AND NOT (toxic = 1 AND doc_id % 3 <> 0), FALSE)"""
_CHAIN = ("tok", "tf", "st", "v", "w", "cell", "td")
for _name in _CHAIN:
    VIEWS[f"live_{_name}"] = re.sub(rf"\b(FROM|JOIN) (d|{'|'.join(_CHAIN)})\b", r"\1 live_\2 AS \2",
                                    VIEWS[_name].replace(N, "(SELECT count(*) FROM d)"))


def _uses(sql: str, name: str) -> bool:
    return re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql) is not None


def _sql(body: str) -> str:
    """Put the views that ``body`` needs, directly or through others, in front of it."""
    needed: list[str] = []
    text = body
    for name in reversed(VIEWS):
        if _uses(text, name):
            needed.insert(0, name)
            text += " " + VIEWS[name]
    head = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in needed)
    return f"WITH {head}\n{body}" if head else body


def _r(x: str, name: str | None = None) -> str:
    return f"round({x}, 6) + 0.0 AS {name or x}"


def _plain(html: str) -> str:
    """Mark-up out, the character references that the pages use resolved."""
    text = (f"regexp_replace({html}, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>', '', 'g')")
    for code, char in (("quot", "'\"'"), ("copy", "chr(169)"), ("middot", "chr(183)")):
        text = f"replace({text}, '&{code};', {char})"
    return f"regexp_replace({text}, '&amp;?', '&', 'g')"


def _counts(pattern: str, where: str = "TRUE", name: str = "n") -> str:
    return f"""SELECT doc_id, term, count(*) AS {name} FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {pattern}))
        AS term FROM documents) WHERE {where} GROUP BY ALL"""


BODIES = {
    "items_flatten": "SELECT * FROM i",
    "group_lookup": "SELECT item_id, grp_id, grp FROM i LEFT JOIN dict USING (grp_id)",
    "ingest_recent": """SELECT event_id, ts, event_type, TIMESTAMP '2024-01-31' AS loaded_at FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-17'
        AND ts <= TIMESTAMP '2024-01-31' ORDER BY ts DESC, event_id LIMIT 50""",
    "malformed_items": "SELECT doc_id, TRUE AS has_raw FROM documents WHERE doc_id % 11 = 3 OR doc_id % 13 = 5",
    "append_rows": "SELECT doc_id, quality, toxic FROM labels",
    "items_with_parent": "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "csv_source": "SELECT doc_id, quality, toxic FROM labels",
    "csv_roundtrip": "SELECT doc_id, source, text FROM documents",
    "term_read": f"SELECT day, grp, term, {_r('mean_prop')} FROM td WHERE term IN (SELECT term FROM f5)",
    "upsert_latest": """SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id
        ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "delete_by_key": "SELECT doc_id, grp FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "page_text": f"SELECT page_id, {_plain('html')} AS text FROM pages",
    "page_content": f"""SELECT page_id, {_plain("regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1)")} AS content
        FROM pages WHERE regexp_matches(html, '<article')""",
    "page_links": """SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS link FROM (
        SELECT page_id, regexp_extract_all(html, '<li><a [^>]*href="([^"]*)"', 1) AS l FROM pages)""",
    "failed_page_filter": f"""SELECT page_id FROM (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'error: {FAILED_MARKER}'
        WHEN page_id % 25 <> 1 THEN html END AS text FROM pages)
        WHERE NOT coalesce(regexp_matches(text, '{FAILED_PATTERN}'), FALSE)""",
    "metadata_backfill": "SELECT doc_id, quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "dedupe_rows": "SELECT DISTINCT source, text FROM documents",
    "drop_nulls": "SELECT item_id FROM i JOIN dict USING (grp_id)",
    "text_assemble": "SELECT item_id, title || chr(10) || description AS text FROM i",
    "group_filter": f"SELECT day, grp, term, {_r('mean_prop')} FROM td WHERE grp IN ({_list(GROUPS)})",
    "pair_filter": f"""SELECT term, g1, g2, {_r('dist')} FROM gd WHERE term IN (SELECT term FROM g1st)
        AND (g1 IN ({_list(GROUPS[:2])}) OR g2 IN ({_list(GROUPS[:2])}))""",
    "pair_groups": """SELECT g1 AS grp FROM gd WHERE term IN (SELECT term FROM g1st)
        UNION SELECT g2 FROM gd WHERE term IN (SELECT term FROM g1st)""",
    "term_groups": "SELECT DISTINCT grp FROM td WHERE term IN (SELECT term FROM f1)",
    "distinct_labels": f"""SELECT word, grp, {_r('dist')} FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY grp) AS rn
        FROM edge WHERE term IN (SELECT term FROM g1st)) WHERE rn = 1""",
    "group_doc_counts": "SELECT source AS grp, count(*) AS n FROM documents GROUP BY source",
    "first_n": "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100",
    "tokens_word": _counts(W3),
    "tokens_ascii": _counts(A2),
    "tokens_min2": _counts(W2),
    "stopword_filter": _counts(W3, f"term NOT IN ({STOP})"),
    "boilerplate_filter": _counts(W3, "term NOT IN (SELECT term FROM boil)"),
    "vocab_filter": _counts(W3, "term IN (SELECT term FROM v)"),
    "filtered_text": f"""SELECT doc_id, coalesce(t, '') AS filtered_text FROM documents LEFT JOIN (
        SELECT doc_id, string_agg(term, ' ' ORDER BY pos) AS t FROM (SELECT doc_id, generate_subscripts(l, 1) AS pos,
        unnest(l) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), {W3}) AS l FROM d))
        WHERE term IN (SELECT term FROM st WHERE df >= 5 GROUP BY term HAVING count(*) >= 2) GROUP BY doc_id) USING (doc_id)""",
    "ngrams_1_2": "SELECT doc_id, term, tf AS n FROM ng",
    "term_counts": _counts(A2, name="tf"),
    "vocab_per_group": "SELECT grp, term, df FROM st2 WHERE df >= 5",
    "vocab_shared": "SELECT term, count(*) AS n_groups FROM st2 WHERE df >= 5 GROUP BY term HAVING count(*) >= 2",
    "vocab_common": f"""SELECT term FROM (SELECT grp, term, count(*) AS df FROM ascii WHERE term NOT IN ({STOP_EN}) GROUP BY ALL)
        JOIN size USING (grp) WHERE df >= 2 AND df <= CAST(0.3 AS DOUBLE) * n GROUP BY term
        HAVING count(*) = (SELECT count(DISTINCT source) FROM documents)""",
    "vocab_pruned": "SELECT term, df, cf FROM v",
    "tfidf": f"SELECT doc_id, term, {_r('w')} FROM w",
    "term_day_mean": f"SELECT day, grp, term, {_r('mean_prop')} FROM td",
    "delta_tfidf": f"SELECT doc_id, term, {_r('w')} FROM live_w",
    "delta_day_mean": f"SELECT day, grp, term, {_r('mean_prop')} FROM live_td",
    "word_trend": f"""SELECT day, grp, term, {_r('mean_prop')}, {_r('avg(mean_prop) OVER (PARTITION BY grp, term ORDER BY day '
        'ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)', 'rolling')} FROM (SELECT day, grp, term, coalesce(mean_prop, 0) AS mean_prop
        FROM td WHERE term IN (SELECT term FROM f1))""",
    "words_union": f"SELECT day, grp, word, {_r('mean_prop')} FROM words",
    "word_proportion": f"SELECT grp, word, {_r('overall_prop')} FROM prop",
    "group_share": f"SELECT grp, word, {_r('overall_prop / sum(overall_prop) OVER (PARTITION BY word)', 'share')} FROM prop",
    "series_map_roundtrip": f"SELECT day, grp, term, {_r('mean_prop')} FROM td WHERE term IN (SELECT term FROM f5)",
    "term_rank": "SELECT day, grp, term, rank FROM mr",
    "term_rank_ordinal": """SELECT day, grp, term, CASE WHEN mean_prop IS NULL THEN -1 ELSE row_number() OVER (
        PARTITION BY day, grp ORDER BY mean_prop NULLS LAST, term) - 1 END AS rank FROM m""",
    "top_term": f"""SELECT day, grp, term FROM (SELECT DISTINCT day, grp FROM m) LEFT JOIN (SELECT day, grp, term FROM (
        SELECT *, row_number() OVER (PARTITION BY day, grp ORDER BY rank, term) AS rn FROM mr
        WHERE term IN ({_list(WORDS)}) AND rank IS NOT NULL) WHERE rn = 1) USING (day, grp)""",
    "series_align": f"SELECT day, grp, {', '.join(_r(w) for w in WORDS)} FROM grid",
    "rank_matrix": """SELECT day, grp, term, rank FROM (SELECT DISTINCT day, grp FROM mr WHERE rank IS NOT NULL)
        CROSS JOIN (SELECT DISTINCT term FROM mr WHERE rank IS NOT NULL) LEFT JOIN mr USING (day, grp, term)""",
    "melt": " UNION ALL ".join(f"SELECT day, grp, '{w}' AS word, {_r(w, 'value')} FROM grid" for w in WORDS),
    "term_corr": f"SELECT grp, term, other, {_r('corr')} FROM corr",
    "word_correlations": f"""SELECT term, grp, other, {_r('corr')} FROM (SELECT *, row_number() OVER (PARTITION BY term, grp
        ORDER BY round(abs(corr), 9) DESC, other) AS rn FROM corr WHERE term IN (SELECT term FROM f5))
        WHERE rn <= 10 AND term <> other""",
    "term_cosine": f"SELECT grp, term, other, {_r('dist')} FROM allcos",
    "term_nearest": f"SELECT term, grp, word, {_r('dist')} FROM cnear",
    "group_distance": f"SELECT term, g1, g2, {_r('dist')} FROM cgd",
    "term_edges_all": f"SELECT term, grp, word, {_r('dist')} FROM cedge",
    "word_rank": """SELECT day, grp, term, n, rank() OVER w + (count(*) OVER (PARTITION BY day, grp, n) - 1) / 2 AS rank FROM (
        SELECT day, grp, term, count(*) AS n FROM tok GROUP BY ALL) WINDOW w AS (PARTITION BY day, grp ORDER BY n DESC)""",
    "term_edges": f"SELECT term, grp, word, {_r('dist')} FROM edge",
    "graph_node_join": f"""SELECT grp, word, {_r('dist')}, count(*) OVER (PARTITION BY grp) AS grp_degree,
        count(*) OVER (PARTITION BY word) AS word_degree FROM edge WHERE term IN (SELECT term FROM g1st)""",
    "pivot_term_vector": f"""SELECT grp, word, round(coalesce(dist, 0), 6) + 0.0 AS dist FROM (SELECT DISTINCT grp FROM near)
        CROSS JOIN (SELECT DISTINCT word FROM near) LEFT JOIN near USING (grp, word)""",
    "svd_energy": f"""SELECT {_r('(SELECT sum(x * x) FROM tx)', 'squares')}, round((SELECT sum(s * s) FROM tg), 3) AS fourths,
        {_r('(SELECT sum(x * x) FROM tx)', 'score_squares')}""",
    "svd_term_products": f"""SELECT p.term, q.term AS other, {_r("coalesce(s, 0)", "s")} FROM tv p CROSS JOIN tv q LEFT JOIN (SELECT a.term, b.term AS other,
        sum(a.x * b.x) AS s FROM tx a JOIN tx b USING (doc_id) GROUP BY ALL) t ON t.term = p.term AND t.other = q.term""",
    "svd_update": f"""SELECT {_r('(SELECT sum(x * x) FROM tx)', 'squares')}, round((SELECT sum(s * s) FROM tg), 3) AS fourths,
        CAST(0 AS DOUBLE) AS sigma_gap, CAST(0 AS DOUBLE) AS angle""",
    "svd_residual": "SELECT CAST(0 AS DOUBLE) AS skew, CAST(0 AS DOUBLE) AS gap",
    "topic_terms": f"SELECT topic_id, term, {_r('weight')}, pos FROM gl",
    "topics_with_term": f"""SELECT topic_id, term, {_r('weight')} FROM gl WHERE term = (SELECT term FROM gl GROUP BY term
        ORDER BY count(*) DESC, term LIMIT 1)""",
    "topic_rows": f"""SELECT topic_id, term, {_r('weight', 'value')}, {_r('sigma')} FROM gl
        JOIN (SELECT topic_id, sqrt(sum(weight * weight)) AS sigma FROM gt GROUP BY topic_id) USING (topic_id)""",
    "topic_composition": f"SELECT topic_id, term, {_r('weight / sum(weight) OVER (PARTITION BY topic_id)', 'share')} FROM gl",
    "topic_labels": "SELECT topic_id, string_agg(term, '-' ORDER BY pos) AS label FROM gl GROUP BY topic_id",
    "topic_scores": f"SELECT doc_id, grp, topic_id, {_r('score')}, {_r('sigma')} FROM es JOIN et USING (topic_id) WHERE topic_id = 3",
    "doc_top_topics": f"SELECT doc_id, grp, topic_id, {_r('score')}, pos FROM top",
    "topic_top_docs": f"""SELECT doc_id, topic_id, {_r('score')} FROM top WHERE topic_id = 0 ORDER BY round(top.score, 9) DESC, doc_id LIMIT 10""",
    "topic_group_diff": f"""SELECT topic_id, g1, g2, {_r('meandiff')}, {_r('se')}, {_r('o.q', 'q')}, round(p, 4) AS p_adj,
        round(meandiff - crit * se, 4) AS lower, round(meandiff + crit * se, 4) AS upper, coalesce(o.q > crit, FALSE) AS reject FROM (
        SELECT *, abs(meandiff) / nullif(se, 0) AS q FROM (SELECT x.topic_id, x.grp AS g1, y.grp AS g2, y.mean - x.mean AS meandiff,
        sqrt(ss / df / 2 * (1 / x.n + 1 / y.n)) AS se, kk.k, df FROM lg x JOIN lg y ON x.topic_id = y.topic_id AND x.grp < y.grp
        JOIN lp ON lp.topic_id = x.topic_id JOIN (SELECT topic_id, count(*) AS k FROM lg GROUP BY topic_id) kk ON kk.topic_id = x.topic_id)) o
        LEFT JOIN crit ON crit.k = o.k AND crit.df = o.df LEFT JOIN tail ON tail.k = o.k AND tail.df = o.df AND tail.q = o.q""",
    "topic_group_distance": f"""SELECT topic_id, g1, g2, {_r('CASE WHEN abs(meandiff) > crit * se THEN abs(meandiff) * sigma ELSE 0 END', 'dist')}
        FROM (SELECT x.topic_id, x.grp AS g1, y.grp AS g2, y.mean - x.mean AS meandiff, sqrt(ss / df / 2 * (1 / x.n + 1 / y.n)) AS se, kk.k, df
        FROM eg x JOIN eg y ON x.topic_id = y.topic_id AND x.grp < y.grp JOIN ep ON ep.topic_id = x.topic_id
        JOIN (SELECT topic_id, count(*) AS k FROM eg GROUP BY topic_id) kk ON kk.topic_id = x.topic_id) o
        JOIN crit ON crit.k = o.k AND crit.df = o.df JOIN et USING (topic_id)""",
    "score_density": f"""SELECT grp, bin, {_r('c / sum(c) OVER (PARTITION BY grp) / step', 'density')} FROM (
        SELECT event_type AS grp, CAST(least(floor((value - lo) / step), 39) AS INTEGER) AS bin, any_value(step) AS step, count(*) AS c
        FROM events CROSS JOIN lim GROUP BY 1, 2)""",
    "score_kernel_density": f"""SELECT grp, point, {_r('any_value(x)', 'x')}, {_r('sum(exp(-((x - value) / h) * ((x - value) / h) / 2) '
        '/ (n * h * sqrt(2 * pi())))', 'density')} FROM (SELECT grp, value, n, h, point, lo + (hi - lo) * point / 39 AS x
        FROM (SELECT event_type AS grp, value FROM events) JOIN (SELECT event_type AS grp, count(*) AS n,
        CAST(0.9 AS DOUBLE) * stddev_samp(value) * pow(count(*), CAST(-0.2 AS DOUBLE)) AS h FROM events GROUP BY 1) USING (grp)
        CROSS JOIN lim CROSS JOIN (SELECT CAST(unnest(range(40)) AS INTEGER) AS point)) GROUP BY grp, point""",
    "date_format_roundtrip": """SELECT day, strftime(day, '%m_%d_%y') AS label, day AS parsed
        FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem)""",
    "json_field_extract": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "stream_upsert": """SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id
        ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "stream_daily": """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n,
        CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS avg_value FROM events
        GROUP BY 1, 2 HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
}


def oracle_sql() -> dict[str, str]:
    return {name: _sql(body) for name, body in BODIES.items()}
