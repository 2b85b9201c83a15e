"""Operators on single texts, against plain Python."""

import brute
import numpy as np
from pyspark.sql import functions as F

from textpulse.llm import decontaminate, langid, pii, quality


def counted(df, columns):
    """Rows as a multiset, as ids may repeat."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_pii_base_spans(docs, none, corpus):
    found = pii.find_pii(docs)
    columns = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "sha"]
    got = found.select("doc_id", *(pii.count_kind(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")),
                       F.sha2(pii.listed(base_only=True), 256).alias("sha"))
    assert counted(got, columns) == sorted(((r[0], *brute.pii_row(r[1])[:5]) for r in corpus), key=str)
    assert pii.find_pii(none).count() == 0


def test_pii_patterns_agree_on_hard_texts(spark):
    texts = ["a@b.c_d@e.f", "x@y..z@w.vu", "1.2.3.4.5.6.7.8", "256.1.1.1 007.0.0.1", "4111 1111-1111 1111 4111111111111111 1",
             "4111111111111112", "+1 (415) 555-0100-", "+123456789012345678", "++1 2 3 4 5 6 7 8 9 0", "9" * 5000, "a." * 3000 + "@",
             "%" * 4000 + "@a.b", "é+44 20 7946 0958é", "😀 ann@x.org 😀 1.1.1.1", "0" * 14, "1 " * 2000, "a@" * 900 + "b.c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(rows).select("doc_id", pii.listed(base_only=True).alias("spans")).collect()}
    assert got == {i: brute.pii_row(t)[5] for i, t in enumerate(texts)}


def test_pii_many_spans_keep_their_places(spark):
    text = " ".join(f"u{i}@example.org" for i in range(700))
    row = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id int, text string")).select(pii.listed().alias("s")).first()
    assert row["s"] == brute.pii_row(text)[5]


def test_pii_added_kinds_need_checksum_or_context(spark):
    rows = spark.createDataFrame([(1, "IBAN DE89 3704 0044 0532 0130 00."), (2, "IBAN DE88370400440532013000"),
                                  (3, "please call 415-555-0100 now"), (4, "order 415-555-0100 now"), (5, "her SSN is 078-05-1120"),
                                  (6, "part 078-05-1120")], "doc_id int, text string")
    got = {r["doc_id"]: [s["kind"] for s in r["pii"]] for r in pii.find_pii(rows).collect()}
    assert got == {1: ["iban"], 2: [], 3: ["local_phone"], 4: [], 5: ["ssn"], 6: []}


def test_redaction(spark, docs, corpus):
    done = pii.redact(pii.find_pii(docs))
    assert done.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in done.collect()}
    assert texts[108] == "Write to [EMAIL] or call [PHONE] today from [IP]."
    assert texts[100] is None and texts[0] == corpus[0][1]
    both = spark.createDataFrame([(1, "😀 +49 1.1.1.1 555 0100 22 é")], "doc_id int, text string")  # an address inside a phone number
    assert pii.redact(pii.find_pii(both)).first()["text"] == "😀 [PHONE] é"


def test_decontamination(docs, none, items, corpus):
    found = decontaminate.find_benchmark(docs, items)
    got = found.select("doc_id", "n_words", "n_hit", F.size("items").alias("n"), decontaminate.items_digest().alias("sha"))
    plain = [(i, t) for i, t in [(1, corpus_item()), (4, "one word")]] + [(None, "prologue then when")]
    want = brute.decontaminate(list(enumerate(r[1] for r in corpus)), plain)
    expect = []
    for i, r in enumerate(corpus):
        n_words, n_hit, _, _, _ = want[i]
        ids = sorted({x for x in brute_items(r[1], plain)})
        expect.append((r[0], n_words, n_hit, len(ids), __import__("hashlib").sha256(",".join(ids).encode()).hexdigest()))
    assert counted(got, got.columns) == sorted(expect, key=str)
    assert decontaminate.find_benchmark(none, items).count() == 0
    assert decontaminate.find_benchmark(docs, items.limit(0)).where("n_hit > 0").count() == 0


def corpus_item():
    from conftest import ITEM
    return ITEM


def brute_items(text, plain):
    named = [(i, t) for i, t in plain if i is not None]
    return [str(i) for i, t in named if brute.decontaminate([(0, text)], [(i, t)])[0][4]]


def test_decontamination_in_blocks_equals_one_pass(docs, items):
    columns = ["doc_id", "n_words", "n_hit", "items"]
    whole = decontaminate.find_benchmark(docs, items).select(*columns)
    blocks = decontaminate.find_benchmark(docs, items, block_bytes=40).select(*columns)
    assert counted(whole, columns) == counted(blocks, columns)


def test_removal_cuts_the_hit_words_only(docs, items, corpus):
    done = decontaminate.remove_hits(decontaminate.find_benchmark(docs.drop("n_words"), items))
    texts = {r["doc_id"]: r["text"] for r in done.collect()}
    assert texts[107].startswith("! And the rest of ") and texts[0] == corpus[0][1] and texts[100] is None
    assert 109 not in texts  # all of its words are an item


def test_quality_base(docs, none, corpus):
    got = quality.judge(docs)
    columns = ["doc_id", *quality.COUNTS, "base_failed"]
    assert counted(got.select(columns), columns) == sorted(((r[0], *brute.quality_base(r[1])) for r in corpus), key=str)
    assert quality.judge(none).count() == 0


def test_quality_repeats(spark):
    eight = "a b c d e f g h"
    texts = [eight + " " + eight, "x\nx\n\n \n x\nx", eight + "\n" + eight + "\r\n" + eight, "#$ % | <>&* £", "a " * 30]
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id int, text string, lang string")
    got = {r["doc_id"]: (*(r[c] for c in quality.COUNTS), r["base_failed"]) for r in quality.judge(rows).collect()}
    assert got == {i: brute.quality_base(t) for i, t in enumerate(texts)}


def test_quality_method_rejects_symbols_and_keeps_prose(spark, corpus):
    mixed = " ".join(f"{a}{i}" for i, a in enumerate(["##", "$$", "%%", "&&"] * 40))
    rows = spark.createDataFrame([(r[0], r[1], r[2]) for r in corpus[:60]] + [(900, mixed, "en")], "doc_id int, text string, lang string")
    judged = {r["doc_id"]: r for r in quality.judge(rows).collect()}
    assert not judged[900]["base_failed"] and not judged[900]["kept"]
    assert all(judged[i]["kept"] != judged[i]["base_failed"] for i in range(60))


def test_distance_is_the_textbook_one():
    p, q = np.array([[0.5, 0.5, 0.0], [1.0, 0.0, 0.0]]), np.array([0.25, 0.25, 0.5])

    def plain(a, b):
        m = [(x + y) / 2 for x, y in zip(a, b)]
        kl = lambda u: sum(x * np.log2(x / z) for x, z in zip(u, m) if x > 0)
        return np.sqrt((kl(a) + kl(b)) / 2)
    assert np.allclose(quality.distance(p, q), [plain(r, q) for r in p])
    assert quality.distance(np.array([[1.0, 0.0]]), np.array([0.0, 1.0]))[0] == 1.0


def test_language_held_out_accuracy(docs, none, corpus):
    import zlib
    found = langid.identify(docs)
    rows = found.collect()
    assert len(rows) == len(corpus)
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None and r["doc_id"] < 60:
            assert r["lang_pred"] == r["lang"]
    odd = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert odd[100] == odd[101] == odd[102] == odd[103] == "und" and odd[105] == "en"
    assert langid.identify(none).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_ignores_label_source_and_id(docs):
    names, matrix = langid.train(docs)
    plain = langid.predict(docs, names, matrix).select("text", "lang_pred")
    moved = langid.predict(docs.withColumns({"lang": F.lit("xx"), "doc_id": F.lit(5).cast("bigint")}), names, matrix).select("text", "lang_pred")
    assert counted(plain, plain.columns) == counted(moved, moved.columns)
