import re

import corpus_pipeline
from martloom.llm.decontam import contaminated, decontaminated, question_answer


def shares(item, text):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda w, k: {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
    out = []
    for part in question_answer(item):
        w = words(part)
        k = min(5, len(w))
        out.append(len(grams(w, k) & grams(words(text), k)) / len(grams(w, k)) if w else 1)
    return min(out)


def test_against_every_pair(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    texts, tests = docs.collect(), items.collect()
    whole = {(d.doc_id, i.item_id) for d in texts for i in tests if i.text in (d.text or "")}
    likely = {(d.doc_id, i.item_id) for d in texts for i in tests if shares(i.text, d.text or "") >= 0.8}
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()}
    assert whole and whole <= got <= likely
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, items, shard_words=300).collect()} == got
    left = {r.doc_id for r in decontaminated(docs, items).collect()}
    assert left == {d.doc_id for d in texts} - {d for d, _ in got}


def test_edges(spark):
    item = "What is the colour of the clear sky at noon?\nIt is blue."
    rows = [(1, None), (2, ""), (3, "a " * 9000 + item + " b" * 9000), (None, item.upper()), (3, item), (4, "It is blue.")]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "..."), (None, "x y")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()} == {(3, 1), (None, 1)}
    assert sorted(r.doc_id for r in decontaminated(docs, items).collect()) == [1, 2, 4]
    assert contaminated(docs, items.limit(0)).collect() == []
    assert contaminated(docs.limit(0), items).collect() == []


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and len(corpus_pipeline.STAGES) == 5
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted(r.doc_id for r in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:]))


def test_items_with_one_or_two_changed_words(spark):
    item = ("Which of the seven rivers in this old valley carries the most water during the spring flood?\n"
            "The northern river carries the most by far.")
    words = item.split(" ")
    changed = lambda *at: " ".join("xx" if k in at else w for k, w in enumerate(words))
    n = len(words)
    texts = [changed(k) for k in range(n)] + [changed(k, (k + 7) % n) for k in range(n)]
    texts += [" ".join(words[:k] + ["xx"] + words[k:]) for k in range(n)] + [" ".join(words[:k] + words[k + 1:]) for k in range(n)]
    question, answer = item.split("\n")
    apart = len(texts)
    texts += [f"{changed(2, 9).splitlines()[0]} Let us think. {answer}", f"{answer} So asks: {question}"]
    clean = [question, answer, f"{question}\nMountains lie far away in snow there.", " ".join(sorted(words))]
    rows = [(k, f"{'before ' * 90}{t}{' after' * 90}") for k, t in enumerate(texts + clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "What is the boiling point of pure water?\nA hundred degrees.")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()}
    assert apart == 4 * n and got == {(k, 1) for k in range(len(texts))}
    left = {r.doc_id for r in corpus_pipeline.decontam.decontaminated(docs, items).collect()}
    assert left == set(range(len(texts), len(rows)))


def test_items_without_id_are_searched(spark):
    item = "What is the colour of the clear sky at noon?\nIt is blue."
    other = "How many legs does a grown spider have in all?\nEight legs."
    docs = spark.createDataFrame([(1, f"so {item} yes"), (2, f"so {other} yes"), (3, "so yes")], "doc_id long, text string")
    items = spark.createDataFrame([(None, item), (5, other), (None, None), (None, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()} == {(1, None), (2, 5)}
    assert [r.doc_id for r in decontaminated(docs, items.where("item_id IS NULL")).collect() if r.doc_id == 1] == []
