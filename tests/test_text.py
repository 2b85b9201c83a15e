import collections
import re

from pyspark.sql import functions as F

from textpulse.functions import dates, text
from textpulse.functions.stopwords import ENGLISH, WITH_EXTRA
from textpulse.operators import terms

TEXTS = [
    (1, "The Élan-vital of हिन्दी2024, don't re_do IT! été"),
    (2, "the of and"),
    (3, ""),
    (4, None),
    (5, "red the red blue, RED x1 ab abc"),
]


def _docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def _tokens(spark, column):
    return {r.doc_id: r.t for r in _docs(spark).select("doc_id", column.alias("t")).collect()}


def test_word_tokens_match_unicode_words_of_python(spark):
    for least in (2, 3):
        got = _tokens(spark, text.word_tokens(F.col("text"), least))
        for doc_id, value in TEXTS:
            want = None if value is None else re.findall(rf"\w{{{least},}}", value.lower())
            assert got[doc_id] == want


def test_ascii_tokens_split_at_accents_digits_and_apostrophes(spark):
    got = _tokens(spark, text.ascii_tokens(F.col("text")))
    assert got[1] == ["the", "lan", "vital", "of", "don", "re", "do", "it"]
    assert got[3] == [] and got[4] is None


def test_bigrams_span_removed_stop_words(spark):
    tokens = terms.tokenize(_docs(spark), text.ascii_tokens, ["the"], bigrams=True)
    got = {r.doc_id: r.tokens for r in tokens.collect()}
    assert got[5] == ["red", "red", "blue", "red", "ab", "abc",
                      "red red", "red blue", "blue red", "red ab", "ab abc"]
    assert got[2] == ["of", "and", "of and"] and got[3] == []


def test_one_token_has_no_bigram(spark):
    tokens = terms.tokenize(spark.createDataFrame([(1, "word")], "doc_id long, text string"), bigrams=True)
    assert tokens.first().tokens == ["word"]


def test_term_counts_equal_a_counter(spark, rows):
    got = rows(terms.term_counts(terms.tokenize(_docs(spark), text.ascii_tokens)))
    want = [(d, t, n) for d, v in TEXTS if v
            for t, n in collections.Counter(re.findall("[a-z]{2,}", v.lower())).items()]
    assert got == sorted(want, key=lambda r: (str(r[0]), r[1]))


def test_term_counts_do_not_shuffle(spark):
    plan = terms.term_counts(terms.tokenize(_docs(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_filtered_text_keeps_order_and_empty_documents(spark, rows):
    docs = _docs(spark)
    vocab = spark.createDataFrame([("red",), ("abc",)], "term string")
    got = rows(terms.filtered_text(docs, terms.tokenize(docs), vocab))
    assert got == [(1, ""), (2, ""), (3, ""), (4, ""), (5, "red red red abc")]


def test_boilerplate_tokens_are_removed(spark, rows):
    counts = terms.term_counts(terms.tokenize(_docs(spark)))
    left = terms.without_terms(counts, terms.boilerplate_terms(spark.createDataFrame([("RED Été",)], "text string")))
    found = {r[0] for r in rows(left.select("term"))}
    assert "red" not in found and "été" not in found and "blue" in found


def test_stop_word_lists():
    assert len(set(ENGLISH)) == 181 and set(WITH_EXTRA) - set(ENGLISH) == {"episode"}


def test_assemble_is_null_when_a_part_is(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None)], "x string, y string")
    assert [r[0] for r in df.select(text.assemble(F.col("x"), F.col("y"))).collect()] == ["a\nb", None]


def test_two_digit_years_come_back(spark):
    days = spark.sql("SELECT explode(array(date'1996-02-29', date'1969-01-01', date'2024-12-31', date'2068-07-04')) AS day")
    back = days.select("day", dates.parse_label(dates.day_label(F.col("day"))).alias("back")).collect()
    assert all(r.day == r.back for r in back)
