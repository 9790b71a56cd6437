import pytest

from shiftwright.llm import language


@pytest.mark.parametrize("text", [None, "", " \t", "123", "½ ² ① Ⅷ", "½", "_", "٣", "!?", "́"])
def test_texts_without_letters(spark, text):
    rows = [(k, "the cat and the dog", "en") for k in range(5)] + [(k, "le chat et le chien", "fr") for k in range(5, 10)]
    training = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, text), (2, "½ the cat"), (3, "le chienⅧ")], "doc_id long, text string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, training).collect()}
    assert found[1] == ("und", 0.0) and found[2][0] == "en" and found[3][0] == "fr"


def test_words_end_at_numbers():
    assert language.words_of("Ab½cd e²f 1g") == ["ab", "cd", "e", "f", "g"]


def test_small_languages_keep_their_words(spark, monkeypatch):
    """One document of a language beside many of another, with bounds that the other alone would fill."""
    monkeypatch.setattr(language, "MAX_WORDS", 40)
    monkeypatch.setattr(language, "MAX_GRAMS", 40)
    monkeypatch.setattr(language, "MIN_ITEMS", 5)
    many = [(k, " ".join(f"{a}{b}ona" for a in "bcdfg" for b in "lmnrst"), "aa") for k in range(60)]
    training = spark.createDataFrame([*many, (100, "zyx wyvz", "zz")], "doc_id long, text string, lang string")
    model = language.fit(training)
    assert model.langs == ["aa", "zz"] and "zyx" in model.words
    assert model.predict("zyx")[0] == "zz" and model.predict("blona")[0] == "aa" and model.predict("zywvz")[0] == "zz"
