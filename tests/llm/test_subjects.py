import random

import numpy as np
import pytest

from ledgerloom.llm import sentences as T, subjects as S

WORDS = {"sport": "goal referee match team league trophy", "law": "court judge verdict appeal witness statute", "music": "violin sonata choir chord tempo orchestra"}
NEUTRAL = "the door of the house stood open and nobody said anything about it until late".split()


def _sentence(rng, area):
    body = rng.sample(NEUTRAL, 7)
    if area:
        body[2:5] = rng.sample(WORDS[area].split(), 3)
    return (" ".join(body) + f" {rng.randrange(99)}.").capitalize()


def _corpus(n=600):
    rng = random.Random(3)
    docs, truth = [], {}
    for i in range(n):
        k = rng.randrange(8)
        areas = [] if k == 0 else rng.sample(list(WORDS), 2 if k == 1 else 1)
        plan = [areas[j % len(areas)] if areas and j < 8 else None for j in range(10 if areas else 6)]
        rng.shuffle(plan)
        docs.append((i, "\n".join(_sentence(rng, a) for a in plan)))
        truth[i] = {a for a in areas if plan.count(a) * 10 >= 3 * len(plan)}
    labels = [(i, f" {rng.choice(sorted(truth[i])).upper()}", "x") for i in range(n) if truth[i] and rng.random() < 0.15] + [(1, "unknown", "x"), (10**9, "law", "x"), (2, None, "x")]
    return docs, truth, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, truth, labels = _corpus()
    extra = [(10_001, None), (10_002, ""), (10_003, "# Heading only"), (10_004, "12\n00:00:01,000 --> 00:00:02,000\n"), (10_005, "x" * 100_000)]
    return (
        spark.createDataFrame([(*d, "sport", 1) for d in docs + extra], "doc_id bigint, text string, subject string, leaf int"),
        spark.createDataFrame(labels, "doc_id bigint, subject string, by string"),
        spark.createDataFrame([(a, "d") for a in WORDS], "subject string, description string"),
        truth,
    )


def test_held_out_accuracy(tables):
    docs, labels, areas, truth = tables
    got = {}
    for i, s in S.subjects(docs, labels, areas, leaves=24).collect():
        got.setdefault(i, set()).add(s)
    hit = sum(len(got.get(i, set()) & t) for i, t in truth.items())
    assert hit / sum(map(len, got.values())) > 0.95 and hit / sum(map(len, truth.values())) > 0.95
    assert not set(got) & {10_001, 10_002, 10_003, 10_004}


def test_edges(spark, tables):
    docs, labels, areas, _ = tables
    assert S.subjects(docs.limit(0), labels, areas).count() == 0
    assert S.subjects(docs, labels.limit(0), areas, leaves=8).count() == 0
    assert S.subjects(docs, labels, areas.limit(0)).count() == 0


def test_sentences():
    text = "# Title\n\n[00:09] Søren — The door opened at 07:49. It closed again!\nMAUD: Am 565. Tag ging es nur um Orgel. Ende gut.\n12\n00:00:01,000 --> 00:00:02,000\n* Item one is here.\nDear Petra,\n"
    got = T.sentences(text)
    assert got[0].strip() == "The door opened at 07:49." and got[1].strip() == "It closed again!"
    assert got[2].strip() == "Am 565. Tag ging es nur um Orgel." and got[3].strip() == "Ende gut." and got[4] == "Item one is here."
    assert T.words("Dear Petra,") == [] and T.sentences(None) == [] and T.sentences("") == []
    assert T.sentences("rÃ©pÃ©tition du chœur.") == ["répétition du chœur."]
    wrapped = "The heirs of Rafe sued over the hall, and the bench reserved it."
    cut = "\n".join(wrapped[i : i + 20] for i in range(0, len(wrapped), 20))
    assert T.sentences(cut) == [wrapped]
    assert T.sentences("One ended.Two began.") == ["One ended.", "Two began."]


def test_language():
    assert T.LANGUAGES[T.language([T.words("Der Hund und die Katze schliefen am Tag.")])] == "de"
    assert T.LANGUAGES[T.language([])] == "other"


def test_labels_of_leaves_by_votes_kin_and_elimination():
    terms = [{"goal": 2.0, "team": 2.0}, {"team": 2.0, "goal": 1.5}, {"court": 2.0, "judge": 1.0}, {"sonate": 2.0}, {"tor": 1.0}, {"sonata": 2.0}]
    votes = np.array([[5, 0, 0], [0, 0, 0], [0, 4, 0], [0, 0, 0], [1, 0, 0], [0, 0, 3]], float)
    out = S.label_leaves(np.array([0, 0, 0, 1, 1, 0]), np.array([9, 9, 9, 9, 9, 9]), votes, terms)
    assert list(out) == [0, 0, 1, 2, 0, 2]


def _hot_corpus(parts, n=600):
    """Texts of one area each, so many in a hundred of each area as parts has, the rest about nothing."""
    rng = random.Random(5)
    of = [a for a, k in parts.items() for _ in range(k)]
    docs, truth = [], {}
    for i in range(n):
        area = (of + [None] * (100 - len(of)))[i * 37 % 100]
        plan = [area] * 6 + [None] * 4 if area else [None] * 6
        rng.shuffle(plan)
        docs.append((i, "\n".join(_sentence(rng, a) for a in plan)))
        truth[i] = {area} - {None}
    return docs, truth, [(i, *truth[i]) for i in range(n) if truth[i] and rng.random() < 0.15]


def _check_hot(spark, parts):
    docs, truth, labels = _hot_corpus(parts)
    d, marks = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, subject string")
    areas = spark.createDataFrame([(a,) for a in WORDS], "subject string")
    got = {}
    for i, s in S.subjects(d, marks, areas, leaves=24).collect():
        got.setdefault(i, set()).add(s)
    for a in WORDS:
        own, found = {i for i, t in truth.items() if a in t}, {i for i, g in got.items() if a in g}
        assert len(own & found) > 0.9 * len(own) and len(own & found) > 0.9 * len(found), (a, len(own), len(found), len(own & found))


def test_area_with_most_of_what_is_labelled(spark):
    _check_hot(spark, {"sport": 36, "law": 12, "music": 12})


def test_weights_do_not_depend_on_the_share_of_a_label():
    c = np.zeros((3, 400))
    c[0, :10], c[1, 10:20], c[:, 20:30], c[:, 30:] = 600, 200, [[60], [20], [20]], 1
    w = S.leaf_weights(np.array([0, 1, -1]), np.zeros(3, int), c, c.sum(1))
    assert (w[0, :10] > S.LEAST_SCORE).all() and (w[1, 10:20] > S.LEAST_SCORE).all() and not w[:2, 20:30].any()
    c[1:] = 0  # a language whose texts are all of one label
    assert (S.leaf_weights(np.array([0, 1, -1]), np.zeros(3, int), c, c.sum(1))[0, :10] > S.LEAST_SCORE).all()


def test_leaves_of_one_label_share_its_terms():
    c = np.ones((4, 30))
    c[:2, :5], c[2, 5:10], c[3, 10:15] = 50, 50, 50
    w = S.leaf_weights(np.array([0, 0, 1, -1]), np.zeros(4, int), c, c.sum(1))
    assert (w[:2, :5] > S.LEAST_LIFT).all() and (w[3, 10:15] > S.LEAST_LIFT).all() and not w[:2, 5:].any()


def test_label_taken_back_where_its_terms_stand_elsewhere():
    c = np.zeros((4, 4))
    c[:2, 0], c[2, :2], c[3, 2:] = 50, [2, 10], 50
    c[0, 1] = c[1, 1] = c[3, 1] = 30
    terms = [{0: 2.0}, {0: 2.0}, {1: 1.0}, {2: 1.0, 3: 1.0}]
    assert list(S.at_home(np.array([0, 0, 1, 2]), np.zeros(4, int), terms, c)) == [0, 0, -1, 2]


def test_bisected():
    rng = np.random.default_rng(1)
    centres = np.eye(8)[:5]
    v = S._unit(np.repeat(centres, [400, 50, 50, 30, 20], axis=0) + rng.normal(0, 0.03, (550, 8)))
    got = S.bisected(v, 5)
    assert sorted((got @ centres.T).argmax(1)) == [0, 1, 2, 3, 4]
    assert len(S.bisected(v[:0], 5)) == 0 and len(S.bisected(v[:1], 5)) == 1
    assert len(S.bisected(np.repeat(v[:1], 9, axis=0), 5)) == 1  # copies are not split


def test_words_are_forgotten_and_reported_again(monkeypatch):
    import pyarrow as pa

    texts = ["alpha beta gamma delta.", "alpha beta gamma epsilon."]
    run = lambda: [w for b in S._tokenise(iter([pa.RecordBatch.from_pydict({"id": [1, 2], "text": texts})])) for f in b.column("fresh").to_pylist() for w in f]
    assert sorted(run()) == ["alpha", "beta", "delta", "epsilon", "gamma"]
    monkeypatch.setattr(S, "REMEMBERED", 1)
    assert sorted(set(run())) == ["alpha", "beta", "delta", "epsilon", "gamma"] and len(run()) == 8


def test_sample_only_places_the_leaves(spark, tables):
    docs, labels, areas, truth = tables
    got = {}
    for i, s in S.subjects(docs, labels, areas, leaves=24, sample=200).collect():
        got.setdefault(i, set()).add(s)
    hit = sum(len(got.get(i, set()) & t) for i, t in truth.items())
    assert hit / sum(map(len, got.values())) > 0.9 and hit / sum(map(len, truth.values())) > 0.9


def test_area_whose_words_are_in_most_texts(spark):
    _check_hot(spark, {"sport": 60, "law": 20, "music": 10})


def test_leaf_without_terms_is_labelled_by_plain_votes():
    out = S.label_leaves(np.array([0, 0, 0]), np.array([9, 9, 9]), np.array([[5, 0], [0, 3], [0, 0]], float), [{}, {"court": 2.0}, {}])
    assert list(out) == [0, 1, -1]


def test_texts_of_another_language_stay_apart():
    used = np.arange(6)
    df = np.zeros((S.L, 6))
    df[0, :3], df[1, 3:5] = 50, 50
    w = S.Words(used, df, np.array([100.0, 100, 0, 0, 10]), df > 0)
    other = S.L - 1
    doc, terms = np.array([0, 0, 1, 1, 2, 2, 2]), np.array([0, 1, 3, 4, 5, 5, 2])
    # by their words: the first is English, the second German, the third has hardly a word of either
    assert list(w.languages([other] * 4, doc, terms)) == [0, 1, other, other]
    assert list(w.languages([2, 2, 2, 2], doc, terms)) == [2, 2, 2, 2]


def test_sparse_weights_score_like_the_table():
    rng = np.random.default_rng(2)
    table = np.where(rng.random((50, 7)) < 0.2, rng.random((50, 7)), 0).astype(np.float32)
    terms, group = rng.integers(0, 50, 300), np.sort(rng.integers(0, 20, 300))
    want = np.zeros((20, 7))
    np.add.at(want, group, table[terms])
    assert np.allclose(S.Weights(table).scores(group, terms, 20), want)
    assert S.Weights(np.zeros((3, 2))).scores(np.array([0, 1]), np.array([0, 2]), 2).shape == (2, 2)
