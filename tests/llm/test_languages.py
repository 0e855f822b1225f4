import numpy as np
import pytest

from codexmill.llm import languages
from codexmill.llm.entry import QUERIES

TEXT = {
    "en": "The old ferryman tells the story backwards while the others are asleep, and nobody in the village forgets the family recipe. ",
    "de": "Der alte Fährmann erzählt die Geschichte rückwärts, während die anderen schlafen, und niemand im Dorf vergisst das Rezept. ",
    "fr": "Le vieux passeur raconte l'histoire à rebours pendant que les autres dorment, et personne au village n'oublie la recette. ",
    "ru": "Старый паромщик рассказывает историю задом наперёд, пока остальные спят, и никто в деревне не забывает семейный рецепт. ",
}


def found(spark, texts):
    """Merged passages of (key, label, text)."""
    rows = [("documents", k, None, None, label, t) for k, label, t in texts]
    df = spark.createDataFrame(rows, "tab string, row_key long, pub_id string, feed string, label string, text string")
    train = spark.createDataFrame([(i, c, t * 6) for i, (c, t) in enumerate(TEXT.items())], "key long, code string, text string")
    return {(r.row_key, r.lang, r.first, r.chars): r.confidence for r in languages.detect(df, train).collect()}


def test_passages_of_mixed_texts(spark):
    mixed = TEXT["en"] * 2 + TEXT["de"] * 3 + TEXT["ru"] * 2
    a, b = len(TEXT["en"]) * 2, len(TEXT["en"]) * 2 + len(TEXT["de"]) * 3
    got = found(spark, [(1, "en", mixed), (1, "en", mixed), (2, "?", "«Der alte Fährmann»\n" + TEXT["fr"] * 2), (3, None, ""), (4, None, None), (5, "de", " \n ")])
    assert {k for k in got if k[0] == 1} == {(1, "en", 0, a - 1), (1, "de", a, b - a - 1), (1, "ru", b, len(mixed) - b - 1)}
    assert {k[1] for k in got if k[0] == 2 and k[3] >= 100} == {"fr"}
    assert not [k for k in got if k[0] in (3, 4, 5)]
    assert all(0 < c <= 1.0000001 for c in got.values())


def test_long_text_and_empty_table(spark):
    assert {k[1] for k in found(spark, [(1, "", TEXT["fr"] * 20_000)])} == {"fr"}
    assert found(spark, []) == {}


def test_labels(spark):
    df = spark.createDataFrame([("en",), ("EN",), ("en_US",), ("deu",), ("Deutsch",), ("Português",), ("zxx",), ("",), (None,), ("sv",), ("pt-BR",)], "l string")
    assert [r[0] for r in df.select(languages.label_code(df.l)).collect()] == ["en", "en", "en", "de", "de", "pt", None, None, None, None, "pt"]


def test_best_path_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(20):
        counts = rng.integers(1, 5, 4)
        text = np.repeat(np.arange(4), counts)
        ll = rng.normal(0, 4, (len(text), 3)).astype(np.float32)
        got = languages._best_path(ll, text, 4)
        for t in range(4):
            own = ll[text == t]
            best = max((sum(own[i, p] for i, p in enumerate(path)) - languages.SWITCH * sum(a != b for a, b in zip(path, path[1:], strict=False)) for path in np.ndindex(*[3] * len(own))))
            path = got[text == t]
            cost = sum(own[i, p] for i, p in enumerate(path)) - languages.SWITCH * sum(a != b for a, b in zip(path, path[1:], strict=False))
            assert cost == pytest.approx(best, abs=1e-3)


def test_every_query_has_its_number():
    assert all(q[0] == "p" and q[1].isdigit() for q in QUERIES)


def test_short_texts_have_a_language(spark):
    docs = spark.createDataFrame([(1, "b", "f", "de", "Der alte Fährmann"), (2, "b", "f", None, ""), (3, "b", "f", None, None), (4, None, None, "fr", TEXT["fr"])], "doc_id long, pub_id string, feed string, lang string, text string")
    elems = spark.createDataFrame([(7, "b", 0, "language", None, "de", "f"), (8, "b", 1, "title", None, "Das Rezept der Familie", "f"), (9, "b", 2, "title", None, None, "f")], "elem_key long, pub_id string, ord int, kind string, xml_lang string, content string, feed string")
    train = spark.createDataFrame([(i, c, t * 6) for i, (c, t) in enumerate(TEXT.items())], "key long, code string, text string")
    rows = {(r.tab, r.row_key): r for r in languages.detect(languages.corpus_texts(docs, elems), train).collect()}
    assert set(rows) == {("documents", 1), ("documents", 4), ("metadata_elements", 7), ("metadata_elements", 8)}
    assert rows["documents", 1].lang == rows["metadata_elements", 8].lang == "de"
    assert all(0 < r.confidence <= 1.0000001 for r in rows.values())


def test_language_of_the_whole_text(spark):
    mixed = TEXT["en"] * 2 + TEXT["de"] * 5
    rows = [("documents", 1, None, None, "en", mixed), ("documents", 2, None, None, None, TEXT["ru"]), ("documents", 3, None, None, "de", None)]
    df = spark.createDataFrame(rows, "tab string, row_key long, pub_id string, feed string, label string, text string")
    train = spark.createDataFrame([(i, c, t * 6) for i, (c, t) in enumerate(TEXT.items())], "key long, code string, text string")
    got = {r.row_key: r for r in languages.text_languages(languages.detect(df, train)).collect()}
    assert set(got) == {1, 2}
    assert (got[1].lang, got[1].label, got[1].languages) == ("de", "en", ["de", "en"])
    assert 0.6 < got[1].share < 0.8
    assert (got[2].lang, got[2].label, got[2].share) == ("ru", None, 1.0)


def test_positions_fit_the_stored_text(spark):
    """Capitals whose lower case has more characters do not shift what follows."""
    head = "\u0130" * 40 + " "
    got = found(spark, [(1, "de", head + TEXT["fr"] * 2 + TEXT["ru"] * 2)])
    assert any(k[1] == "ru" and k[2] == len(head) + 2 * len(TEXT["fr"]) for k in got)
