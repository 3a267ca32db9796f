import random

from lodestone.llm import language, toxicity

WORDS = {
    "en": "the of and to in is that it for was with are bonther stand weather thing".split(),
    "de": "der die und das ist nicht von zu mit den auf schule größe über keit ung".split(),
    "fr": "le les des et est dans une pour pas sur qui du eau être façon où".split(),
    "es": "el los del las por con una para como su al lo niño canción dónde año".split(),
}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


def test_languages(spark):
    rng = random.Random(4)
    langs = sorted(WORDS)
    rows = [(i, prose(rng, langs[i % 4], rng.randint(8, 80)), langs[i % 4]) for i in range(400)]
    odd = [(900, None, "en"), (901, "", "en"), (902, "12 ... !", "de"), (903, prose(rng, "fr", 20_000), None), (903, "los del las una niño", "es"), (None, "und das ist nicht über", None)]
    frame = spark.createDataFrame([(*r, 1.0) for r in rows + odd], "id long, text string, lang string, score double")
    model = language.fit(frame.where("id < 300"), sample=120)
    assert model.families == ["germanic", "romance"] and set(model.inner) == {("de", "en"), ("es", "fr")}
    got = [(r.id, r.lang_pred, r.score) for r in language.identify(frame, model, id_column="id").collect()]
    assert len(got) == len(rows) + len(odd) and all(0 <= s <= 1 for _, _, s in got)
    found = {i: p for i, p, _ in got}
    assert sum(found[i] == g for i, _, g in rows[300:]) >= 98
    assert [found[i] for i in (900, 901, 902)] == ["und"] * 3 and found[None] == "de"
    assert {p for i, p, _ in got if i == 903} == {"fr", "es"}
    one = language.fit(frame.where("lang = 'en'"))
    assert {r.lang_pred for r in language.identify(frame, one, id_column="id").collect()} == {"en", "und"}
    assert language.fit(frame.where("id < 0")) is None
    assert {r.lang_pred for r in language.identify(frame, None, id_column="id").collect()} == {"und"}


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(700):
        lang, toxic = rng.choice(sorted(WORDS)), int(rng.random() < 0.25)
        words = prose(rng, lang, rng.randint(5, 60)).split(" ")
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["Nasty", "vile!", "grumpf" + rng.choice(["er", "en", "ig", "os"])]))
        rows.append((i, " ".join(words), lang))
        labels.append((i, toxic))
    rows += [(900, None, "en"), (901, "", "en"), (902, "!!!", None), (903, prose(rng, "en", 30_000) + " nasty", "en"), (0, "repeated id", "en"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "id long, text string, score string")
    given = spark.createDataFrame([*labels[:500], (900, 1), (990, 1), (901, None), (None, 1)], "id long, label int")
    model = toxicity.fit(given, docs)
    got = [(r.id, r.score, r.predicted) for r in toxicity.score(docs, model, keep=("id",)).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 and p == (s >= 0.5) for _, s, p in got)
    found = {i: p for i, _, p in got}
    held = labels[500:]
    caught, real = sum(found[i] for i, y in held if y), sum(y for _, y in held)
    wrong = sum(found[i] for i, y in held if not y)
    assert caught >= 0.9 * real and wrong <= 4
    assert found[903] == 1 and found[900] == found[901] == found[902] == 0
    empty = toxicity.fit(given.where("id < 0"), docs)
    assert toxicity.score(docs, empty, keep=("id",)).count() == len(rows)
