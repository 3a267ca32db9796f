"""The classifier learns from all labelled texts and takes its thresholds from all that are kept out."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.llm import toxicity


def test_a_word_beyond_the_first_texts_is_learned(spark):
    rng = random.Random(9)
    plain = "the of and to in is that it for was stand weather thing school water".split()
    frame = spark.range(9200).select("id", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(11), F.col("id")))).alias("place"))
    rows = []
    for r in frame.collect():
        toxic = int(r.id % 8 < 3)
        words = [rng.choice(plain) for _ in range(rng.randint(4, 12))]
        # Only texts late in the order of the hash hold the second word.
        if toxic:
            words.insert(rng.randrange(len(words)), "grumpfel" if r.place > 8200 else "nasty")
        rows.append((r.id, " ".join(words), toxic))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "id long, label int")
    model = toxicity.fit(labels, docs)
    new = [(i, " ".join(rng.choice(plain) for _ in range(8)) + (" grumpfel" if i % 2 else "")) for i in range(200)]
    found = {r.id: r.predicted for r in toxicity.score(spark.createDataFrame(new, "id long, text string"), model, keep=("id",)).collect()}
    assert sum(found[i] for i in range(1, 200, 2)) >= 95 and sum(found[i] for i in range(0, 200, 2)) <= 2


def test_shards_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab cd ef gh ij".split()) for _ in range(6)) + (" vile" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "id long, label int")
    one = toxicity.fit(labels, docs, shard_texts=50)
    two = toxicity.fit(labels.repartition(5), docs.repartition(7), shard_texts=50)
    assert abs(one.table - two.table).max() < 1e-4 and abs(one.thresholds - two.thresholds).max() < 0.1
    scores = {r.id: r.predicted for r in toxicity.score(docs, one, keep=("id",)).collect()}
    assert all(scores[i] == y for i, _, y in rows)
