"""The lexicon automaton against plain edit distances; windows; training and awkward rows."""

import random

from pyspark.sql import functions as F

from graphproof.llm.toxicity import Automaton, Scanner, Term, reject_toxic, toxicity, train

WORDS = ["scum", "moron", "idiot", "loser", "pathetic", "worthless"]
TERMS = [Term(w, False, 3.0, 2.0) for w in WORDS] + [Term("vequ", True, 4.0)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(word):
    found = [(distance(word, t.text), t.text) for t in TERMS if not t.stem and distance(word, t.text) <= t.edits]
    found += [(0, t.text) for t in TERMS if t.stem and word.startswith(t.text)]
    return min(found)[0] if found else None


def test_automaton_equals_edit_distance():
    rng, automaton = random.Random(3), Automaton(TERMS)
    letters = "moronidtlseapvequ"
    words = ["", "vequ", "xvequ", "vequation", "idi0t", "idiots", "diot", "iidiot", "scums", "worthles", "wrthless", "worthlesss", "wrthles"]
    for w in WORDS * 150:
        w = list(w)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) + 1)
            w[i:i + rng.randrange(2)] = rng.choices(letters, k=rng.randrange(2))
        words.append("".join(w))
    for w in words:
        found = automaton.read(w)
        assert (None if found is None else found[1]) == brute(w), w


def test_windows_tell_quotation_from_abuse():
    scanner = Scanner(TERMS)
    alone = scanner.features("well you moron of a clerk")
    quoted = scanner.features('the word "moron" stands in the old book')
    heaped = scanner.features("you moron and idiot")
    assert alone[0] > 0 and alone[3] == 0
    assert quoted[0] == 0 and quoted[3] > 0
    assert heaped[2] > 0 and scanner.features("you id1ot x")[1] > 0
    assert scanner.features('"moron" you idiot "loser"')[3] == 0


def frames(spark):
    rng = random.Random(1)
    plain = ["lorem", "ipsum", "dolor", "sit", "amet", "elit"]
    docs, labels = [], []
    for i in range(400):
        words = rng.choices(plain, k=30)
        if i % 4 == 0:
            words[rng.randrange(30)] = rng.choice(WORDS)
        docs.append((i, " ".join(words) + f" n{i}"))
        labels.append((i, 1, int(i % 4 == 0)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learnt_model_holds_on_other_rows(spark):
    docs, labels = frames(spark)
    model = train(docs, labels, F.col("doc_id") % 5 != 0)
    scored = docs.filter("doc_id % 5 = 0").select("doc_id", toxicity(model)("text").alias("s")).collect()
    assert sum((r.s >= 0.5) == (r.doc_id % 4 == 0) for r in scored) >= 0.97 * len(scored)
    odd = spark.createDataFrame(
        [(1, None), (2, ""), (None, "you PATHETIC moron"), (4, "x " * 100_000), (5, "lorem idiot"), (5, "lorem idiot")],
        "doc_id long, text string").withColumn("score", F.lit("clash"))
    kept = reject_toxic(odd, model)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    assert reject_toxic(odd.limit(0), model).count() == 0


def test_no_labels_no_rejections(spark):
    docs, labels = frames(spark)
    for none in (labels.limit(0), labels.withColumn("toxic", F.lit(0)), labels.withColumn("toxic", F.lit(None).cast("int"))):
        model = train(docs, none)
        assert docs.select(toxicity(model)("text").alias("s")).agg(F.max("s")).first()[0] == 0.0
