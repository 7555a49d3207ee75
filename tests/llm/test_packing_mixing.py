import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing, packing, tokens


def _docs(n, seed=0):
    rng = random.Random(seed)
    return [(i, rng.choice(["hot"] * 6 + ["b", "c", None]), rng.choice([0, 1, 5, 50, 300, 700, rng.randrange(1, 900)]) if rng.random() < 0.97 else rng.randrange(2000, 9000)) for i in range(n)]


@pytest.mark.parametrize("part_tokens", [40_000, 10_000_000])
def test_packing_keeps_everything(spark, part_tokens):
    docs = _docs(900)
    df = spark.createDataFrame(docs, "id bigint, source string, n_tokens bigint")
    out = packing.pack_sized(df, {"hot": 0.5, "absent": 0.2}, capacity=1000, part_tokens=part_tokens).toPandas()
    used = out.groupby(["part", "container"])["n_tokens"].sum()
    assert used.max() <= 1000
    whole = out.groupby("id")["n_tokens"].sum()
    assert {i: int(n) for i, n in whole.items()} == {i: n for i, _, n in docs}
    for i, s, n in docs:
        own = out[out["id"] == i].sort_values("piece_no")
        assert list(own["token_start"]) == list(range(0, max(n, 1), 1000)) and set(own["source"]) == {s or ""}
    full = used.sum() / (1000 * len(used))
    assert full > (0.97 if part_tokens > 1e6 else 0.9)


def test_windows_follow_the_shares():
    rng = random.Random(1)
    items = [(rng.randrange(20, 120), i, 0, 0, "a" if i % 2 else "b") for i in range(4000)]
    windows = packing.pack_queues(items, {"a": 0.75, "b": 0.25}, {}, 1000)
    first = windows[:60]
    a = sum(n for w in first for n, *_, s in w if s == "a") / sum(n for w in first for n, *_ in w)
    assert abs(a - 0.75) < 0.02 and sum(map(len, windows)) == 4000
    owed = packing.pack_queues(items, {"a": 0.75, "b": 0.25}, {"b": 20_000.0, "a": -20_000.0}, 1000)
    assert all(s == "b" for w in owed[:5] for *_, s in w)


def test_deficits_are_carried_over_partitions(spark):
    docs = [(i, "a" if i < 300 else "b", 100) for i in range(600)]
    df = spark.createDataFrame(docs, "id bigint, source string, n_tokens bigint")
    out = packing.pack_sized(df, {"a": 0.9, "b": 0.1}, capacity=1000, part_tokens=20_000).toPandas()
    assert out["part"].nunique() == 3 and out.groupby(["part", "container"])["n_tokens"].sum().max() <= 1000 and len(out) == 600


def test_schedule_serves_shares_until_a_source_ends():
    import numpy as np

    s = packing.schedule_of({"a": 100, "b": 900, "c": 500}, {"a": 0.5, "b": 0.25, "c": 0.25})
    assert np.allclose(s.got(np.array([0.0, 100.0, 200.0, 1200.0, 1500.0])), [[0, 0, 0], [50, 25, 25], [100, 50, 50], [100, 600, 500], [100, 900, 500]])
    assert np.allclose(s.place(np.array([0.0, 200.0, 2000.0])), [0, 200, 1100])


def test_partitions_have_the_target_shares_while_sources_last(spark):
    rng = random.Random(4)
    docs = [(i, "big" if i % 5 else "small", rng.randrange(20, 400)) for i in range(6000)]
    df = spark.createDataFrame(docs, "id bigint, source string, n_tokens bigint")
    shares = {"small": 0.5, "big": 0.5}
    out = packing.pack_sized(df, shares, capacity=1000, part_tokens=100_000)
    out.cache()
    assert out.agg(F.sum("n_tokens")).first()[0] == sum(n for *_, n in docs)
    rows = {(r.part, r.source): r.share for r in packing.part_shares(out, shares).collect()}
    early = [rows[p, "small"] for p in range(3)]
    last = max(p for p, _ in rows)
    assert all(abs(x - 0.5) < 0.1 for x in early) and rows[last, "big"] > 0.99
    f = packing.fill(out, shares, 1000).toPandas()
    assert f["used"].sum() == sum(n for *_, n in docs) and (f["left_over"] >= 0).all() and ((f["off_target"] >= 0) & (f["off_target"] <= 0.5001)).all()


def test_packing_edges(spark):
    none = spark.createDataFrame([], "id bigint, source string, n_tokens bigint")
    assert packing.pack_sized(none, {}).count() == 0
    zero = spark.createDataFrame([(1, "a", 0), (2, None, None)], "id bigint, source string, n_tokens bigint")
    assert packing.pack_sized(zero, {"a": 1.0}).count() == 2
    texts = spark.createDataFrame([(1, "hello world", "a", 7), (2, None, "a", 7), (3, "x " * 5000, "b", 7), (3, "x " * 5000, "b", 7)], "doc_id bigint, text string, source string, n_tokens int")
    out = packing.pack_documents(texts, {})
    n = len(tokens.encoding().encode_ordinary("x " * 5000))
    assert out.where("id = 3").agg(F.sum("n_tokens")).first()[0] == 2 * n


def test_token_counts_match_the_tokenizer(spark):
    texts = ["", "a", "Grüße aus 東京", "<|endoftext|>", "\x00\n\n  x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    enc = tokens.encoding()
    got = {r.id: r.n_tokens for r in tokens.token_counts(df, "id", "text", []).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts)}
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts)


def _mix(spark, docs, targets, **kw):
    df = spark.createDataFrame(docs, "id bigint, source string, n_tokens bigint, digest binary")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats bigint")
    out, shares = mixing.mix(df, t, **kw)
    return out.toPandas(), {r.source: r for r in shares.collect()}


def test_mix_shares_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 100)
    rng = random.Random(2)
    docs = [(i, "big" if i < 1500 else "small" if i < 1600 else "tiny" if i < 1605 else "untargeted", rng.randrange(10, 300), i.to_bytes(4, "big")) for i in range(1800)]
    docs += [(9000 + i, "small", d[2], d[3]) for i, d in enumerate(docs[1500:1550])]  # exact copies count as one text
    out, shares = _mix(spark, docs, [("big", 0.7, 1), ("small", 0.2, 4), ("tiny", 0.05, 2), ("gone", 0.05, 3), (None, 0.5, 1)], curriculum={"big": (1.5, 0.5), "small": (0.2, 1.8)})
    assert not set(out["source"]) - {"big", "small", "tiny"} and (out["id"] < 9000).all()
    uses = out.groupby("id").size()
    assert uses.max() <= 4 and out[out["source"] == "big"].groupby("id").size().max() == 1
    assert not out.duplicated(["id", "copy"]).any()
    total = sum(d[2] for d in docs[:1605])
    for s, share in (("big", 0.7), ("small", 0.2)):
        assert abs(shares[s].tokens - share * total) <= 300 and shares[s].reached
        assert abs(shares[s].actual_share - shares[s].tokens / out["n_tokens"].sum()) < 1e-9
    assert not shares["tiny"].reached and shares["tiny"].most_uses == 2 and shares["tiny"].tokens == 2 * sum(d[2] for d in docs[1600:1605])
    assert shares["gone"].tokens == 0 and not shares["gone"].reached
    assert out["position"].is_monotonic_increasing and out["position"].between(0, 1).all()
    # the demand met by time t follows the integral of the schedule
    big = out[out["source"] == "big"]
    for t in (0.25, 0.5, 0.75):
        met = big[big["position"] <= t]["n_tokens"].sum() / big["n_tokens"].sum()
        assert abs(met - (1.5 * t - 0.5 * t * t)) < 0.01


def test_mix_edges(spark):
    out, shares = _mix(spark, [], [("a", 1.0, 1)])
    assert len(out) == 0 and shares["a"].tokens == 0
    out, shares = _mix(spark, [(1, "a", 5, b"x"), (2, None, 5, b"y"), (3, "a", 0, b"z")], [("a", None, None), ("b", 0.0, 1)])
    assert len(out) == 0
    out, _ = _mix(spark, [(1, "a", 5, b"x"), (3, "a", 0, b"z")], [("a", 1.0, None), ("a", 1.0, 1)], total_tokens=5)
    assert out["n_tokens"].sum() == 5
