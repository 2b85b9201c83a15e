"""URL filter: rules first, then the log-likelihood ratio of two character models; DataFrame functions only.

The models for accepted and rejected URLs are variable-order Markov models: the probability of a character mixes the count
of (context, character) with the probability given the next shorter context, so contexts that were never seen hand over to
shorter ones. Contexts have up to ``ORDER`` characters. Counts are a table keyed by the character string itself, which grows
with the URLs and is joined by key; only a table measured at no more than ``BROADCAST_BYTES`` is broadcast. All URLs that a
rule decides are counted, except the fifth on which the limit is calibrated.

What a character adds to the score depends on it and its context only, so it is computed once for each distinct string.

A URL's score is the difference of its log-likelihoods divided by its length. The limit is the one that separates the held
back URLs best (largest sum of both classes' shares on their side), in the middle between the scores around it.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule; a URL without characters
scores null and is blocked, as there is nothing to fetch; without accepted or rejected examples to learn from, every score
is 0, and without any to calibrate on the limit is 0, so undecided URLs are allowed; repeated rows are judged alike; other columns
are kept, columns named like the results are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpulse.llm.tables import stored

ORDER = 3
BROADCAST_BYTES = 16 << 20
WEIGHT = 4.0  # of the shorter context's probability, in observations
ALPHABET = 256
EDGE = 10.0
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def with_rule(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (host and path of the longest that fits) and ``_action``."""
    host, path = host_and_path(url)
    out = pages.drop("host", "path", "rule", "verdict", "score").withColumns({"host": host, "path": path})
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first
        fits = ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return out.withColumns({"rule": rule, "_action": action})


def _broadcast_if_small(table: DataFrame, key: str, most: int) -> DataFrame:
    """``table`` (written before), marked for broadcast if its rows, at 64 bytes and their key each, have at most ``most`` bytes."""
    size = table.agg(F.sum(F.octet_length(key) + 64)).first()[0] or 0
    return F.broadcast(table) if size <= most else table


def _positions(urls: DataFrame) -> DataFrame:
    """A row per character of each ``url``: ``s1`` the character, ``s2`` with the one before it, and so on."""
    padded = urls.withColumn("_p", F.concat(F.lit("\2" * ORDER), F.lower("url"), F.lit("\3")))
    rows = padded.select("*", F.explode(F.sequence(F.lit(1 + ORDER), F.length("_p"))).alias("_i"))
    return rows.select(*urls.columns, *(F.substring("_p", F.col("_i") - k + 1, F.lit(k)).alias(f"s{k}") for k in range(1, ORDER + 2)))


def train(decided: DataFrame) -> DataFrame:
    """Counts of the strings of 1 to ``ORDER + 1`` characters: ``(string, accepted, rejected)``; the empty string holds totals.

    ``decided`` has ``url`` and ``accepted`` (boolean).
    """
    rows = _positions(decided.select("url", "accepted"))
    cells = rows.select("accepted", F.explode(F.array(F.lit(""), *(F.col(f"s{k}") for k in range(1, ORDER + 2)))).alias("string"))
    return cells.groupBy("string").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


def _ratios(strings: DataFrame, model: DataFrame, accepted: int, rejected: int, most: int) -> DataFrame:
    """``(string, ratio)`` of distinct strings of ``ORDER + 1`` characters: what their last character adds to the score."""
    # The count of a context is that of the string of its characters.
    tail = {f"s{k}": F.right("string", F.lit(k)) for k in range(1, ORDER + 2)}
    parts = tail | {f"c{k}": F.left(tail[f"s{k + 1}"], F.lit(k)) for k in range(1, ORDER + 1)}
    asked = strings.select("string", F.inline(F.array(*(F.struct(F.lit(n).alias("name"), c.alias("part")) for n, c in parts.items()))))
    counts = _broadcast_if_small(model.where("string <> ''").withColumnRenamed("string", "part"), "part", most)
    found = asked.join(counts, "part", "left").groupBy("string").agg(*(
        F.sum(F.when(F.col("name") == n, F.col(of))).alias(f"{n}_{of[0]}") for n in parts for of in ("accepted", "rejected")))

    def log_probability(kind: str, all_: int) -> Column:
        def n(name: str) -> Column:
            return F.coalesce(F.col(f"{name}_{kind}"), F.lit(0)).cast("double")
        p = (n("s1") + WEIGHT / ALPHABET) / (all_ + WEIGHT)
        for k in range(1, ORDER + 1):
            p = (n(f"s{k + 1}") + WEIGHT * p) / (F.greatest(n(f"c{k}"), n(f"s{k + 1}")) + WEIGHT)
        return F.log(p)

    return found.select("string", (log_probability("a", accepted) - log_probability("r", rejected)).alias("ratio"))


def score(urls: DataFrame, model: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(url, score)`` of distinct URLs. Tables of strings larger than ``broadcast_bytes`` are joined by shuffles."""
    distinct = urls.select("url").distinct()
    total = model.where("string = ''").select("accepted", "rejected").first()
    if total is None or not total["accepted"] or not total["rejected"]:
        return distinct.select("url", F.when(F.length("url") > 0, F.lit(0.0)).alias("score"))
    rows = _positions(distinct).select("url", F.col(f"s{ORDER + 1}").alias("string"))
    ratios = stored(_ratios(rows.select("string").distinct(), model, *total, broadcast_bytes), "url-ratios")
    rows = rows.join(_broadcast_if_small(ratios, "string", broadcast_bytes), "string")
    return rows.groupBy("url").agg((F.sum("ratio") / F.count("*")).alias("score")).select(
        "url", F.when(F.length("url") > 0, F.round("score", 9)).alias("score"))


def calibrate(scored: DataFrame) -> float:
    """The limit for ``score`` that separates ``accepted`` from the others best, from a histogram of 2,001 bins."""
    cell = F.round(F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), F.col("score"))), 2)
    bins = scored.where("score IS NOT NULL").groupBy(cell.alias("limit")).agg(
        F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    whole = Window.partitionBy()
    below = Window.orderBy("limit").rowsBetween(Window.unboundedPreceding, -1)
    gain = (F.coalesce(F.sum("r").over(below), F.lit(0)) / F.sum("r").over(whole)
            - F.coalesce(F.sum("a").over(below), F.lit(0)) / F.sum("a").over(whole))
    usable = (F.sum("r").over(whole) > 0) & (F.sum("a").over(whole) > 0)
    before = F.coalesce(F.lag("limit").over(Window.orderBy("limit")), F.col("limit"))
    best = bins.select(((F.col("limit") + before) / 2).alias("limit"), F.when(usable, gain).alias("gain")).where(
        "gain IS NOT NULL").orderBy(F.desc("gain"), "limit").first()
    return 0.0 if best is None else float(best["limit"])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``score`` (of URLs without a rule) and ``verdict``: allow or block."""
    ruled = with_rule(pages, rules, url)
    decided = ruled.where("_action IS NOT NULL").select(F.col(url).alias("url"), (F.col("_action") == "allow").alias("accepted")).distinct()
    decided = decided.withColumn("held", F.crc32("url") % 5 == 0)
    model = stored(train(decided.where("NOT held")), "url-model")
    held = decided.where("held")
    limit = calibrate(held.join(score(held, model), "url"))
    open_ = ruled.where("_action IS NULL").select(F.coalesce(F.col(url), F.lit("")).alias("url"))
    scores = score(open_, model).select(F.col("url").alias("_url"), "score")
    # Pages with a rule take no part in the join: without a key they would all meet in one task.
    rest = ruled.where("_action IS NULL").withColumn("_key", F.coalesce(F.col(url), F.lit("")))
    rest = rest.join(scores, F.col("_key") == F.col("_url"), "left").drop("_key", "_url")
    passes = F.when(F.col("score") >= limit, "allow").otherwise("block")
    ruled = ruled.where("_action IS NOT NULL").withColumn("score", F.lit(None).cast("double"))
    return ruled.unionByName(rest).withColumn("verdict", F.coalesce("_action", passes)).drop("_action")
