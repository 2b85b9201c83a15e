"""From texts to (document, term) rows.

One row of ``docs`` is one document. All token work of a document happens inside its row, so counting the terms of
every document needs no shuffle whatever the size of the corpus. The generators are the *outer* ones on purpose: for
the inner ones the optimizer infers a filter on the array's size, pushes it below the projection and so tokenises every
text twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse.functions.text import drop_words, unigrams_bigrams, word_tokens
from textpulse.operators.sizes import small

Tokenizer = Callable[[Column], Column]


def tokenize(docs: DataFrame, tokenizer: Tokenizer = word_tokens, stop_words: Iterable[str] = (),
             bigrams: bool = False, text: str = "text") -> DataFrame:
    """``docs`` with its text replaced by ``tokens``; stop words go before bigrams are formed."""
    out = docs.withColumn("tokens", drop_words(tokenizer(F.col(text)), stop_words)).drop(text)
    return out.withColumn("tokens", unigrams_bigrams(F.col("tokens"))) if bigrams else out


def token_rows(tokenized: DataFrame) -> DataFrame:
    """One row per token with its position in the document."""
    keys = [c for c in tokenized.columns if c != "tokens"]
    return tokenized.select(*keys, F.posexplode_outer("tokens").alias("pos", "term")).where(F.col("term").isNotNull())


def term_counts(tokenized: DataFrame) -> DataFrame:
    """``tf`` per document and term, for all other columns of ``tokenized`` as they are.

    The sorted token array is cut at the places where a new term starts; the distance between two cuts is the count.
    """
    keys = [c for c in tokenized.columns if c != "tokens"]
    at = lambda array, i: F.get(F.col(array), i)
    ordered = tokenized.select(*keys, F.sort_array("tokens").alias("_s"))
    cut = ordered.withColumn("_cuts", F.filter(
        F.sequence(F.lit(1), F.size("_s")), lambda i: (i == 1) | (at("_s", i - 1) != at("_s", i - 2))))
    runs = cut.select(*keys, F.transform("_cuts", lambda i, k: F.struct(
        at("_s", i - 1).alias("term"),
        (F.coalesce(at("_cuts", k + 1), F.size("_s") + 1) - i).cast("long").alias("tf"))).alias("_runs"))
    return runs.select(*keys, F.inline_outer("_runs")).where(F.col("term").isNotNull())


def without_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows whose term is not in ``terms`` (a boilerplate text's tokens, a stop list kept as a table).

    Such lists are small but not bounded by anything here, so the join strategy is left to their measured size.
    """
    return rows.join(terms.select("term"), "term", "left_anti")


def only_terms(rows: DataFrame, vocab: DataFrame, vocab_rows: int | None = None) -> DataFrame:
    """Rows whose term is in the vocabulary; ``vocab_rows`` is the vocabulary's cap or count, if known."""
    return rows.join(small(vocab.select("term"), vocab_rows), "term", "left_semi")


def boilerplate_terms(texts: DataFrame, tokenizer: Tokenizer = word_tokens) -> DataFrame:
    """The distinct tokens of a fixed promotional text."""
    return token_rows(tokenize(texts, tokenizer)).select("term").distinct()


def filtered_text(docs: DataFrame, tokenized: DataFrame, vocab: DataFrame, key: str = "doc_id",
                  vocab_rows: int | None = None) -> DataFrame:
    """Each document's surviving tokens in order, joined by blanks; a document that lost all keeps ``""``."""
    rows = only_terms(token_rows(tokenized.select(key, "tokens")), vocab, vocab_rows)
    kept = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("_kept"))
    joined = kept.select(key, F.array_join(F.col("_kept.term"), " ").alias("filtered_text"))
    return docs.select(key).join(joined, key, "left").select(
        key, F.coalesce("filtered_text", F.lit("")).alias("filtered_text"))
