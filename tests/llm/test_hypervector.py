import random
import zlib

from eventloom.llm import hypervector as H

SEEDS = {"en": "the of and to in is that with for was", "de": "der die und nicht sie ist ein mit für auf", "fr": "le la et les des est que une dans qui"}


def documents():
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(SEEDS[lang].split()) for _ in range(60)), lang) for i, lang in enumerate(list(SEEDS) * 40)]
    return [*rows, (1000, None, "en"), (1001, "12 34 ...", "de"), (1002, "", None), (1003, "Ж", None), (1004, "le la les " * 50_000, None)]


def test_held_out_accuracy_and_unknown(spark):
    df = spark.createDataFrame([(*r, 0.5) for r in documents()], "doc_id long, text string, lang string, score double")
    langs, protos = H.prototypes(df.where(H.fold("doc_id", 5) != 0))
    got = {r["doc_id"]: r for r in H.identify(df, langs, protos).collect()}
    held = [(i, lang) for i, t, lang in documents() if i < 1000 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i]["lang_pred"] == lang for i, lang in held)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1004]["lang_pred"] == "fr" and all(0 <= r["score"] <= 1 for r in got.values())


def test_letters_of_every_plane_and_ties(spark):
    rows = [(1, "\U00010414\U00010428\U00010429 \U0001043d", "xx"), (2, "\U00020000\U00020001", None), (3, "abc", "aa"), (4, "abc", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, protos = H.prototypes(df)
    got = {r["doc_id"]: r for r in H.identify(df, langs, protos).collect()}
    assert got[1]["lang_pred"] == "xx" and got[1]["score"] > 0.9 and got[2]["lang_pred"] != "und"
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == "aa"  # a tie goes to the smaller name


def test_cosine_by_brute_force():
    """A text's cosine with a prototype, from letter vectors bound and bundled one by one."""
    import numpy as np

    H.gram_vectors(np.zeros(1, np.int64))
    letters = H._cache["letters"][H.GRAM - 1]  # not rolled
    texts = ["the cat", "der Hund läuft", "the dog, the cat!"]

    def vector(text):
        slots = [0, *[int(H.slots()[ord(c)]) for c in text], 0]
        slots = [s for i, s in enumerate(slots) if s or not i or slots[i - 1]]
        out = np.zeros(H.DIMENSIONS, np.int64)
        for i in range(len(slots) - H.GRAM + 1):
            bound = np.ones(H.DIMENSIONS, np.int64)
            for place in range(H.GRAM):
                bound *= np.roll(letters[slots[i + place]].astype(np.int64), H.GRAM - 1 - place)
            out += bound
        return out

    for t in texts:
        assert (H.gram_vectors(H.grams(t)).sum(0) == vector(t)).all()


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame(documents()[:5], "doc_id long, text string, lang string")
    langs, protos = H.prototypes(df.limit(0))
    assert {r["lang_pred"] for r in H.identify(df, langs, protos).collect()} == {"und"}
    assert H.identify(df.limit(0), langs, protos).count() == 0
