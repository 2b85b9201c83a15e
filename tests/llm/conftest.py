import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, n_words string, kept string, copies string"
PROSE = {
    "en": "the quick brown fox number {i} jumps over the lazy dog and then walks home through the quiet evening town while it rains on roof {i}",
    "de": "der schnelle braune fuchs nummer {i} springt über den faulen hund und geht dann durch die stille stadt nach hause wo es auf dach {i} regnet",
    "fr": "le renard brun et rapide numéro {i} saute par-dessus le chien paresseux puis rentre à la maison sous la pluie du soir près du toit {i}",
}
ITEM = "when forty winters shall besiege thy brow and dig deep trenches in thy beauty field"


@pytest.fixture(scope="session")
def corpus():
    """Prose in three languages, and every odd case: nulls, empty and blank texts, repeated rows, one very long text."""
    rows = []
    for i in range(60):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, "\n".join(PROSE[lang].format(i=f"{i}{j}") for j in range(3)), lang, f"s{i % 4}" if i % 7 else "hot"))
    long = " ".join(PROSE["en"].format(i=i * 7) for i in range(2500))
    rows += [
        (100, None, "en", "s1"), (101, "", "en", None), (102, " \t\n ", None, "s1"), (103, "12 34 !!", "en", "s2"),
        (104, rows[0][1], "en", "hot"), (105, rows[0][1].replace("rains", "pours", 1), None, "hot"), (105, rows[0][1].replace("rains", "pours", 1), None, "hot"),
        (106, long, "en", "s3"), (107, f"Prologue, then {ITEM.upper()}! And the rest of {rows[3][1]}", "en", "s1"),
        (108, "Write to ann.lee@mail.example.com or call +1 (415) 555-0100 today from 10.0.0.255.", "en", "s2"),
        (109, "One word", "en", "s2"), (110, "one WORD", "en", "s2"), (None, rows[1][1], "de", None),
        (111, "İstanbul ẞ 𝔘nicode 😀 ñandú café@exämple.com a@b.co_c@d.org +12 ", None, "s9"),
    ]
    return [(*r, len(r[1] or ""), "x", "y", "z", "w") for r in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "docs")
    spark.createDataFrame(corpus, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "one word"), (None, "prologue then when"), (1, ITEM), (9, "...")],
                                 "item_id bigint, text string")
