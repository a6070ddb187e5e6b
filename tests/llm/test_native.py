"""Mixing and fingerprints."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.llm import mixing, queries, syncmers
from tests.llm.helpers import many, odd_docs, prose


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_are_those_of_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    df = queries.queries()[name](spark, sf)
    found = con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    place = [list(found.columns).index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in place)) for r in found.fetchall())


def by_hand(sizes: dict, weights=(3, 1, 2)):
    """Targets by sharing again and again until none is over its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    rest = 1.5 * sum(sizes.values())
    while open_ and rest > 1e-9:
        total = sum(weight[s] for s in open_)
        gain = {s: rest * weight[s] / total for s in open_}
        rest = 0.0
        for s, g in gain.items():
            target[s] += g
            if target[s] >= 2 * sizes[s]:
                rest += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_targets_by_hand(spark):
    for seed in range(4):
        df, rows = many(spark, 50, seed)
        sizes = {}
        for r in rows:
            sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
        got = mixing.mix(df).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.max(F.col("taken") / F.col("size")).alias("m")).collect()
        want = by_hand(sizes)
        for r in got:
            assert r.t == pytest.approx(want[r.source]) and abs(r.n - r.t) <= 0.5 and r.m <= 2


def test_mix_of_odd_tables(spark):
    for df in (odd_docs(spark), odd_docs(spark, True)):
        out = mixing.mix(df)
        assert out.count() == df.count()
        assert out.where("size = 0").agg(F.sum("taken")).first()[0] == 0
        whole = mixing.mixed_rows(df)
        assert whole.columns == df.columns and whole.count() > 0
    assert mixing.mix(odd_docs(spark).limit(0)).isEmpty()
    a, b = (sorted(map(str, mixing.mix(odd_docs(spark).repartition(n)).collect())) for n in (1, 5))
    assert a == b


def test_positions_invert_demand():
    for ramp in (0.5, 0.0, -0.5):
        for k in range(11):
            t = k / 10
            done = (1 - ramp) * t + ramp * t * t
            a = 1 - ramp
            back = done if ramp == 0 else ((a * a + 4 * ramp * done) ** 0.5 - a) / (2 * ramp)
            assert back == pytest.approx(t)


def plain_sketch(text):
    t = [x for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()) for x in ([w] if len(w) <= 32 else w)]
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    if len(t) < 6:
        return [md5(" ".join(t))[:12]] if t else []
    r = [md5(" ".join(t[i : i + 3])) for i in range(len(t) - 2)]
    return sorted({r[i][:6] + r[i + 3][:6] for i in range(len(r) - 3) if min(r[i], r[i + 3]) <= min(r[i + 1], r[i + 2])})[:64]


def test_sketches_and_next_documents(spark):
    df, rows = many(spark, 40)
    order = sorted(rows, key=lambda r: -r[0])
    after = {a[0]: b[1] for a, b in zip(order, order[1:] + order[:1])}
    for r in syncmers.edit_probe(df).collect():
        text, nxt = rows[r.doc_id][1], after[r.doc_id]
        m = len(text) // 3
        edited = text[: len(text) - m] + nxt[:m]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(text)
        assert r.fingerprint == "".join(plain_sketch(text)) and r.edited_fingerprint == "".join(plain_sketch(edited))
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1


def test_fingerprints_of_odd_tables(spark):
    out = syncmers.edit_probe(odd_docs(spark, True))
    assert out.count() == odd_docs(spark).count()
    assert syncmers.edit_probe(odd_docs(spark).limit(0)).isEmpty()
    assert syncmers.edit_probe(odd_docs(spark).where("doc_id = 4")).first().near_next == 1.0
    only_null = syncmers.edit_probe(odd_docs(spark).where("doc_id is null"))
    assert only_null.count() == 2
    by_text = {}
    for r in syncmers.edit_probe(odd_docs(spark)).select("doc_id", "n_chars", "fingerprint").collect():
        assert by_text.setdefault((r.doc_id, r.n_chars), r.fingerprint) == r.fingerprint


def test_anchors_match_passages(spark):
    passage = prose(60, 9)
    texts = {0: f"{prose(10, 1)} {passage} {prose(20, 2)}", 1: f"{prose(35, 3)} {passage}", 2: prose(80, 4), 3: passage}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    best = {}
    for r in syncmers.positional_matches(df.where("doc_id = 0"), df).collect():
        best[r.doc_id] = max(best.get(r.doc_id, r), r, key=lambda r: r.n_anchors)
    assert {d: r.shift for d, r in best.items()} == {0: 0, 1: 25, 3: -10}
    for d in (1, 3):
        assert 10 <= best[d].query_from < 15 and 65 < best[d].query_to < 70 and best[d].n_anchors > 15


@pytest.mark.parametrize("kind", ["spaced", "unspaced"])
def test_an_insertion_changes_only_anchors_near_it(spark, kind):
    rng = random.Random(5)
    text = prose(700, 5) if kind == "spaced" else "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(2000))
    mark = "new " if kind == "spaced" else "\u4e00"
    edits = [mark + text, text[:900] + mark + text[900:], text]
    df = spark.createDataFrame(list(enumerate(edits)), "doc_id long, text string")
    names = {}
    for r in syncmers.anchor_rows(df).collect():
        names.setdefault(r.doc_id, set()).add(r.name)
    assert len(names[2]) > 150
    for d in (0, 1):
        assert len(names[d] & names[2]) >= 0.95 * len(names[2])


def test_mixed_rows_are_in_training_order(spark):
    df, _ = many(spark, 120)
    for schedule in ({}, {"cap": 3.0, "share": 2.5}):
        each = []
        for r in mixing._mixed(df, **schedule).collect():
            each += [(r["__times"][i], r.doc_id, i) for i in range(r.copies)]
        assert each != sorted(each) and any(i for _, _, i in each)
        assert [r.doc_id for r in mixing.mixed_rows(df, **schedule).collect()] == [d for _, d, _ in sorted(each)]
    plain = [(r.position if i == 0 else r.position_2, r.doc_id) for r in mixing.mix(df).collect() for i in range(r.copies)]
    assert [r.doc_id for r in mixing.mixed_rows(df).collect()] == [d for _, d in sorted(plain)]
