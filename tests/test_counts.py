"""Counts by word numbers against counts of words; frequent terms by a table of hashes; cosines from a row a document."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textpulse.functions import text
from textpulse.operators import counts, distance, terms, vocab
from textpulse.plans import oracle, recipes


@pytest.fixture
def docs(spark):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("ab", "cde", "fghi")]
    made = [(i, None if i % 19 == 4 else "xyz"[i % 3], " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(120)]
    return spark.createDataFrame([*made, (200, "x", None), (201, "y", ""), (7, "y", "aab aab bab"), (7, "y", "aab aab bab")],
                                 "doc_id bigint, grp string, text string")


@pytest.mark.parametrize("buckets", [counts.BUCKETS, 8])
def test_frequent_cells_lose_no_frequent_term(docs, rows, monkeypatch, buckets):
    monkeypatch.setattr(counts, "BUCKETS", buckets)
    monkeypatch.setattr(counts, "BLOCK", buckets)
    tokenized = terms.tokenize(docs, text.ascii_tokens, ["bab"])
    cells = counts.frequent_cells(tokenized, 6, bigrams=True)
    assert cells.count() == docs.count()
    known = terms.term_counts(terms.tokenize(docs, text.ascii_tokens, ["bab"], bigrams=True))
    often = known.groupBy("term").agg(F.count("*").alias("df")).where("df >= 6")
    found = cells.select("doc_id", "grp", F.inline("cells"))
    columns = ["doc_id", "grp", "term", "tf"]
    want = rows(known.join(often, "term", "left_semi").select(columns))
    assert rows(found.join(often, "term", "left_semi").select(columns)) == want != []
    assert (found.count() < known.count()) == (buckets > 8)  # the others go unless they share a bucket


@pytest.mark.parametrize("asked", [["aab"], ["aab", "cde", "aab cab", "none"], []])
def test_cosine_of_chosen_terms_from_a_row_a_document(spark, docs, rows, asked):
    twice = docs.where("doc_id % 5 = 0").withColumn("grp", F.when(F.col("doc_id") % 10 == 0, F.lit("z")).otherwise(F.col("grp")))
    docs = docs.unionByName(twice).unionByName(docs.where("doc_id % 7 = 1").withColumn("doc_id", F.lit(None).cast("bigint")))
    cells = counts.frequent_cells(terms.tokenize(docs, text.ascii_tokens), 4, bigrams=True).persist()
    long = cells.select("doc_id", "grp", F.inline("cells"))
    words = vocab.prune(vocab.term_totals(long), F.lit(120), 4, 1.0, cap=None)
    kept = terms.only_terms(long, words)
    chosen = spark.createDataFrame([(t,) for t in asked], "term string")
    chosen = chosen.join(words, "term", "left_semi")
    found = distance.term_cosine(kept, words, 100, chosen, cells)
    assert bool(asked) == bool(found.count())
    assert rows(found) == rows(distance.term_cosine(kept, words, 100, chosen))


@pytest.mark.parametrize("tokens", [counts.TOKENS, 40])
def test_group_statistics_from_a_row_a_term_of_a_piece(docs, rows, monkeypatch, tokens):
    monkeypatch.setattr(counts, "TOKENS", tokens)
    tokenized = terms.tokenize(docs, text.ascii_tokens, ["bab"])
    tf = terms.term_counts(tokenized)
    parts = counts.group_counts(tokenized)
    assert parts.count() < tf.count()
    columns = ["grp", "term", "df", "cf"]
    assert rows(vocab.group_term_stats(parts).select(columns)) == rows(vocab.group_term_stats(tf).select(columns)) != []


def test_cosines_of_all_terms_are_those_of_each_term(spark, docs, rows):
    twice = docs.where("doc_id % 5 = 0").withColumn("grp", F.when(F.col("doc_id") % 10 == 0, F.lit("z")).otherwise(F.col("grp")))
    again = docs.unionByName(twice).unionByName(docs.where("doc_id % 7 = 1").withColumn("doc_id", F.lit(None).cast("bigint")))
    for some in (docs.where("doc_id <> 7"), again):
        cells = counts.frequent_cells(terms.tokenize(some, text.ascii_tokens), 4, bigrams=True).persist()
        words = vocab.prune(vocab.term_totals(cells.select(F.inline("cells"))), F.lit(120), 4, 1.0, cap=None).persist()
        kept = terms.only_terms(cells.select("doc_id", "grp", F.inline("cells")), words)
        found = rows(distance.term_cosine(kept, words, 100, cells=cells))
        assert found == rows(distance.term_cosine(kept, words, 100, words, cells)) and len({r[1] for r in found}) == words.count()


def test_the_query_compares_all_terms_of_all_pages(spark, docs, rows, tmp_path):
    documents = docs.where("grp IS NOT NULL AND text IS NOT NULL AND doc_id <> 7").where("doc_id < 40").withColumnRenamed("grp", "source")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    found = recipes.QUERIES["term_cosine"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(oracle._sql(oracle.BODIES["term_cosine"])).fetchall()
    columns = [c[0] for c in con.description]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(want)
    assert len({r[columns.index("term")] for r in want}) > 20
