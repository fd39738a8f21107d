"""Subjects: sentences, votes, calibration, held-out agreement with the hand labels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from sightline.llm.subjects import BUCKETS, FIT_SENTENCES, _hash, calibrate, classify, excerpt, fit, letter_groups, mend, read, sentences, train, vote
from sightline.sources.tables import table


def test_sentences():
    assert [s.strip() for s in sentences("One two. Three!\n- Four five? ... 12")] == ["one two", "three", "four five"] or len(sentences("One two. Three!\n- Four five?")) == 3
    assert sentences("") == [] and sentences(" .!\n ") == [] and sentences("12 34") == []
    assert len(sentences("<p>A b</p><p>C d</p>")) == 2
    assert len(sentences("สมุดรายชื่อนักเรียน (1) กลุ่มอนุบาลเริ่มหลัง")) == 2
    assert mend("Ã¼ber") == "über" and mend("plain") == "plain"
    assert [len(read([t])[0].column) for t in ("a", "12", "red car", "red. car")] == [0, 0, 3, 2]


def test_reading_at_once_is_reading_one_by_one():
    texts = ["", "One red car. A b c!", "12 34.", "Über-Straße 7\r\nändert – é", "สมุดรายชื่อ นักเรียน abc de (1) กลุ่มอนุบาลเริ่มหลัง", "a. b. c", "no end", "x - y - zebra crossing zebra crossing", "。！bold？ end"]
    x, of = read(texts)
    rows = {i: set() for i in range(x.n)}
    for r, c in zip(x.row.tolist(), x.column.tolist()):
        rows[r].add(c)
    got = {}
    for r, d in enumerate(of.tolist()):
        got.setdefault(d, []).append(rows[r])
    for d, t in enumerate(texts):
        want = [set(letter_groups(s)) for s in sentences(t)]
        assert sorted(map(sorted, got.get(d, []))) == sorted(map(sorted, want)), t
    assert x.column.max() < BUCKETS and _hash("ab") >= 0 > _hash("a") > _hash(".")


def test_excerpt():
    long = ". ".join(f"word{'abcdefghij'[i % 10]} x{i} {'kl' * (i % 7)}" for i in range(5000))
    assert len(sentences(excerpt(long))) == FIT_SENTENCES and excerpt("One two. Three") == "one two\n three" and excerpt("") == ""


def test_vote():
    got = vote([(1, "Law", "a"), (1, "law", "a"), (1, "sport", "b"), (2, None, "a"), (2, "law", "b"), (2, None, "c"), (3, "nonsense", "a"), (4, "MACHINE_LEARNING", None)], ["law", "machine_learning", "sport"])
    assert got == {1: {0, 2}, 2: set(), 4: {1}}


def test_calibration_finds_the_valley():
    share = np.concatenate([np.full((50, 1), 0.05), np.full((50, 1), 0.4)])
    truth = np.concatenate([np.zeros((50, 1)), np.ones((50, 1))]) > 0
    assert 0.1 < calibrate(share, truth)[0] <= 0.32


TOPICS = {"law": ["court", "judge", "appeal", "statute"], "sport": ["goal", "referee", "match", "league"], "food": ["soup", "kitchen", "oven", "flour"]}
NEUTRAL = ["camera", "checked", "shift", "note", "desk", "frame", "entry", "closed"]


def made(rng, areas, mention=None):
    say = lambda pool: " ".join(rng.choice(pool) for _ in range(6))
    out = [say(TOPICS[a] + NEUTRAL[:2]) for a in areas for _ in range(4)] + [say(NEUTRAL) for _ in range(4)]
    if mention:
        out.append(say(TOPICS[mention] + NEUTRAL))
    rng.shuffle(out)
    return ". ".join(out) + "."


def test_made_topics():
    rng, names = random.Random(0), sorted(TOPICS)
    docs = [(rng.sample(names, rng.choice([0, 1, 1, 2])), rng.choice([None, *names])) for _ in range(300)]
    texts = [made(rng, a, m) for a, m in docs]
    model = fit(texts[:200], [{names.index(x) for x in a} for a, _ in docs[:200]], names)
    share = model.shares(texts[200:]) >= model.share
    truth = np.array([[n in a for n in names] for a, _ in docs[200:]])
    assert (share == truth).mean() > 0.97
    assert fit(["a b"], [set()], names) is None


def test_operator(spark):
    rng, names = random.Random(1), sorted(TOPICS)
    areas = {i: rng.sample(names, rng.choice([0, 1, 1, 2])) for i in range(240)}
    rows = [(i, made(rng, a)) for i, a in areas.items()]
    rows += [(900, None), (901, ""), (902, " \n"), (903, made(rng, ["law"]) * 300), (0, rows[0][1])]
    areas |= {903: ["law"]}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("subject", F.lit("clash")).repartition(3)
    given = [(i, n, "a") for i, a in areas.items() if i % 2 == 0 for n in a or [None]]
    labels = spark.createDataFrame(given + [(None, "law", "a"), (777, "law", "a")], "doc_id long, subject string, annotator string")
    subjects = spark.createDataFrame([(n,) for n in TOPICS] + [(None,)], "subject string")
    got = [(r.doc_id, r.subject) for r in classify(docs, "doc_id", "text", train(docs, "doc_id", "text", labels, subjects)).collect()]
    want = {(i, n) for i, a in areas.items() for n in a}
    assert len(set(got) & want) > 0.93 * len(want) and len(set(got) - want) < 0.07 * len(want)
    assert (903, "law") in got and not {900, 901, 902} & {d for d, _ in got}
    assert sum(d == 0 for d, _ in got) == 2 * len({s for d, s in got if d == 0})
    empty = classify(docs, "doc_id", "text", train(docs, "doc_id", "text", labels.limit(0), subjects))
    assert empty.count() == 0 and empty.columns == ["doc_id", "subject", "share"]
    assert classify(docs.limit(0), "doc_id", "text", train(docs, "doc_id", "text", labels, subjects)).count() == 0


@pytest.mark.parametrize("folder", [DATA.replace("0.001", "0.1")])
def test_held_out(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "doc_labels")
    kept, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    model = train(docs, "doc_id", "text", kept, table(spark, folder, "subjects"))
    got = {(r.doc_id, r.subject) for r in classify(docs, "doc_id", "text", model).collect()}
    truth = vote([(r.doc_id, r.subject, r.annotator) for r in held.collect()], model.names)
    want = {(d, model.names[k]) for d, ks in truth.items() for k in ks}
    own = {g for g in got if g[0] in truth}
    assert len(own & want) / len(want) > 0.92 and len(own & want) / max(1, len(own)) > 0.92
