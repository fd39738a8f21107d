"""The index against plain searching; copies, disguises and near misses of test items."""

import random

import numpy as np

import sightline.llm.leaks as leaks_module
from sightline.llm.leaks import GAP, LEAST_PASSAGE, FmIndex, Items, Wavelet, find_leaks, removal_spans, shard_leaks, suffix_array, words


def test_index():
    rng = np.random.default_rng(0)
    for n, size in ((1, 3), (2, 2), (60, 3), (2000, 9), (500, 1)):
        s = rng.integers(0, size, n)
        assert suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
        w = Wavelet(s, size)
        for c in range(size):
            at = np.arange(n + 1)
            assert w.rank(np.full(n + 1, c), at).tolist() == [int((s[:i] == c).sum()) for i in at]
        fm = FmIndex(s, size)
        phrases = rng.integers(0, size, (40, 3))
        low, high = fm.search(phrases)
        for p, a, b in zip(phrases, low, high):
            assert sorted(fm.locate(np.arange(a, b)).tolist()) == [i for i in range(n - 2) if (s[i : i + 3] == p).all()]


def test_repeats_sort_fully():
    s = np.array([1, 2, 3, 0] * 300)
    assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_words():
    plain = ["the", "caretaker", "folds", "13", "towels"]
    for t in ("The caretaker folds 13 towels!", "THE care-\ntaker  folds １３ towels", "<p>The <b>caretaker</b></p> folds&nbsp;13 towels", "Thе саretаkеr fоlds 13 tow​els­", "the\\ncaretaker\\tfolds 13 \\u0074owels", "𝔗𝔥𝔢 caretaker folds 13 towels"):
        assert words(t) == plain, t


def plain(doc, item):
    """The words of an item that a document repeats, by the definition, one word after another."""
    n, half = min(3, len(item)), -(-len(item) // 2)
    hits = [i for i in range(len(doc) - n + 1) if any(doc[i : i + n] == item[j : j + n] for j in range(len(item) - n + 1))]
    groups = []
    for i in hits:
        if groups and i - (groups[-1][-1] + n) <= GAP:
            groups[-1].append(i)
        else:
            groups.append([i])
    said, spans = set(), []
    for g in groups:
        if len({k for i in g for k in range(i, i + n)}) >= min(LEAST_PASSAGE, half):
            said |= {k for i in g for j in range(len(item) - n + 1) if doc[i : i + n] == item[j : j + n] for k in range(j, j + n)}
            spans.append((g[0], g[-1] + n))
    return (len(said), spans) if 2 * len(said) >= len(item) else None


def test_against_plain(monkeypatch):
    rng = random.Random(2)
    for width in (2, 5, 40):
        items = [[f"w{rng.randrange(width)}" for _ in range(rng.choice((1, 2, 3, 5, 12, 30)))] for _ in range(15)]
        docs = []
        for _ in range(40):
            text = [f"w{rng.randrange(width + 3)}" for _ in range(rng.choice((0, 1, 4, 30, 120)))]
            if rng.random() < 0.7:
                i, at = rng.choice(items), rng.randint(0, len(text))
                text[at:at] = [w for w in i if rng.random() < 0.9]
            docs.append(text)
        known = Items([(k, " ".join(i)) for k, i in enumerate(items)])
        want = {(d, k): r for d, doc in enumerate(docs) for k, i in enumerate(items) if (r := plain(doc, i))}
        numbered = [np.array([known.number.get(w, 1) for w in d], dtype=np.int64) for d in docs]
        for shard, places in ((250_000, 2_000_000), (37, 3)):
            monkeypatch.setattr(leaks_module, "SHARD_WORDS", shard)
            monkeypatch.setattr(leaks_module, "PLACES", places)
            got = {(d, i): (n, s) for d, k, n, s in shard_leaks(numbered, known) for i in known.ids[k]}
            assert got == want
        assert want


def found(spark, texts, items, **more):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    e = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    return {(r.doc_id, r.item_id) for r in find_leaks(d, "doc_id", "text", e, "item_id", "text", **more).collect()}


def test_items_that_share_words(spark):
    rng = random.Random(1)
    say, noise = " ".join, lambda n: [f"x{rng.randrange(500)}" for _ in range(n)]
    one = item(rng)
    for n in (5, 50):
        assert found(spark, [say(noise(9) + one + noise(9)), say(noise(50))], [say(one)] * n) == {(0, k) for k in range(n)}
    siblings = [say(one[:55] + [f"own{k}{j}" for j in range(5)]) for k in range(50)]
    assert found(spark, [siblings[7]], siblings) == {(0, k) for k in range(50)}
    assert found(spark, [siblings[7]], siblings, block_chars=1000) == {(0, k) for k in range(50)}
    forms = [say(one[:20] + [f"own{k}_{j}" for j in range(40)]) for k in range(50)]
    assert found(spark, [forms[7]], forms) == {(0, 7)}


def test_short_items_and_pieces(spark):
    rng = random.Random(3)
    say, noise = " ".join, lambda n: [f"x{rng.randrange(500)}" for _ in range(n)]
    items = [[f"s{n}_{j}" for j in range(n)] for n in range(1, 8)]
    assert found(spark, [say(noise(30) + i + noise(30)) for i in items], [say(i) for i in items]) == {(k, k) for k in range(7)}
    one = item(rng)
    docs = []
    for n in range(3, 8):
        pieces = [one[a : a + n] for a in range(0, 60, n)]
        rng.shuffle(pieces)
        docs.append(say(noise(20) + sum(pieces, []) + noise(20)))
    for n in range(4, 9):
        docs.append(say(x if k % n else "changed" for k, x in enumerate(one)))
    docs.append(say(noise(200) + one[:40] + noise(3)))
    docs.append(say(one[:15] + noise(500) + one[30:45] + noise(500) + one[50:60]))
    assert found(spark, docs, [say(one)]) == {(k, 0) for k in range(len(docs))}
    assert found(spark, [say(one[:29] + noise(5)), say(w for k in range(0, 60, 3) for w in one[k : k + 2] + noise(1))], [say(one)]) == set()


VOCABULARY = [f"w{i}" for i in range(400)]


def item(rng):
    return rng.sample(VOCABULARY, 60)


def test_found(spark):
    rng = random.Random(5)
    items = [item(rng) for _ in range(30)]
    noise = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    say = " ".join
    docs, want = [], set()

    def add(text, i=None):
        docs.append((len(docs), text))
        if i is not None:
            want.add((len(docs) - 1, 100 + i))

    for i, w in enumerate(items):
        add(say(noise(20) + w + noise(20)), i)
        add(say(w[:40]).upper().replace(" ", "\n\t"), i)
        add(say(noise(5) + w[30:55] + noise(30) + w[:20] + noise(4)), i)  # rearranged
        add(say(x if k % 9 else "changed" for k, x in enumerate(w)), i)  # single words changed
        add(say(noise(20) + w[:15] + noise(20)))  # a few words
    add(say(items[0] + items[1]), 0)
    want.add((len(docs) - 1, 101))
    add(say(noise(4000) + items[2] + noise(4000)), 2)
    for empty in (None, "", "  ", "…"):
        add(empty)
    add(docs[0][1], 0)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F_lit("clash")).repartition(4)
    e = spark.createDataFrame([(100 + i, say(w)) for i, w in enumerate(items)] + [(900, None), (901, ""), (None, say(items[0])), (902, "w1 w2")], "item_id long, text string")
    leaks = find_leaks(d, "doc_id", "text", e, "item_id", "text")
    got = {(r.doc_id, r.item_id) for r in leaks.collect()}
    assert got == want | {(k, 902) for k, t in docs if t and " w1 w2 " in f" {' '.join(words(t))} "}
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in removal_spans(leaks, "doc_id").collect()}
    assert set(spans) == {d for d, _ in got} and spans[0] == [(20, 80)]
    assert all(a[1] < b[0] for s in spans.values() for a, b in zip(s, s[1:]))
    assert find_leaks(d.limit(0), "doc_id", "text", e, "item_id", "text").count() == 0
    assert find_leaks(d, "doc_id", "text", e.limit(0), "item_id", "text").count() == 0


def F_lit(v):  # noqa: N802
    from pyspark.sql import functions as F

    return F.lit(v)
