"""SimHash classes, components, paragraph dedup."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from barloom.llm import components, paragraphs, simhash
from tests.llm.helpers import ODD, join, many, odd_docs, prose, root


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 80)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        join(parent, a, b)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    want = {x: root(parent, x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert {r.node: r.component for r in got.collect()} == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


def plain_hash(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    h = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_by_hand():
    for t in [*ODD, prose(300, 1), prose(3, 2), prose(2, 3)]:
        assert simhash.simhash(t) == plain_hash(t)


@pytest.mark.parametrize("wide", [256, 2])
def test_near_pairs_connect_all_that_are_near(spark, wide):
    rng = random.Random(8)
    prints = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(8):
            y = x
            for _ in range(rng.randint(0, 4)):
                y ^= 1 << rng.randrange(64)
            prints.add(y)
    prints |= {0, (1 << 64) - 1, 7, 1 << 63, (1 << 63) | 3}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    want = {tuple(sorted((signed[a], signed[b]))) for a in prints for b in prints if a < b and bin(a ^ b).count("1") <= 3}
    got = simhash.near_pairs(spark.createDataFrame([(v,) for v in signed.values()], "fp long"), wide)
    assert {tuple(sorted((r.a, r.b))) for r in got.collect()} == want


def test_classes_by_hand(spark):
    df, rows = many(spark, 80)
    prints = {r[0]: plain_hash(r[1]) for r in rows}
    parent = {i: i for i in prints}
    for a in prints:
        for b in prints:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3:
                join(parent, a, b)
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.classes(df).collect()} == {i: (prints[i], root(parent, i)) for i in prints}
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == sorted({root(parent, i) for i in prints})


def test_odd_classes(spark):
    df = odd_docs(spark, True)
    assert simhash.classes(df).count() == df.count()
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and kept.where("doc_id = 6").count() == 2  # two texts under one id, one row of each
    assert kept.where("text is null or trim(text) = ''").count() == 1
    assert simhash.classes(df.limit(0)).isEmpty() and simhash.keep_one(df.limit(0)).isEmpty()


def plain_repeats(rows):
    units = {(d, k): line.lower().split() for d, text in rows for k, line in enumerate((text or "").split("\n")) if len(line.split()) >= paragraphs.WORDS}
    sets = {u: paragraphs.shingles(" ".join(w)) for u, w in units.items()}
    parent = {u: u for u in units}
    for a in units:
        for b in units:
            if a < b and len(sets[a] & sets[b]) >= paragraphs.LIKE * len(sets[a] | sets[b]):
                join(parent, a, b)
    groups = {}
    for u in units:
        groups.setdefault(root(parent, u), []).append(u)
    return {u: g[0][0] if (g := sorted(groups[root(parent, u)])) else None for u in units if len(groups[root(parent, u)]) > 1}


def test_repeats_by_hand(spark):
    df, rows = many(spark, 80)
    got = paragraphs.repeats(df).where("kind = 'paragraph'").collect()
    assert {(r.doc_id, r.line): r.component_id for r in got} == plain_repeats([(r[0], r[1]) for r in rows])
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert texts[r.doc_id][r.start : r.end] == texts[r.doc_id].split("\n")[r.line].strip() and len(texts[r.doc_id][r.start : r.end].split()) == r.n_words
    kept = {}
    for r in got:
        kept.setdefault((r.component_id,), []).append(r.kept)
    assert all(any(v) for v in kept.values())


def test_passages_inside_other_paragraphs(spark):
    passage = prose(60, 77)
    rows = [(i, f"{prose(40 + i, i)} {passage} {prose(30, 100 + i)}", "en", "s", 0) for i in range(6)] + [(9, prose(150, 555), "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = paragraphs.repeats(df).collect()
    assert {r.doc_id for r in got} == set(range(6)) and {r.component_id for r in got} == {0}
    for r in got:
        assert rows[r.doc_id][1][r.start : r.end] in passage and r.n_words >= paragraphs.WORDS and r.kept == (r.doc_id == 0)


def test_odd_repeats(spark):
    df = odd_docs(spark, True)
    out = paragraphs.repeats(df)
    assert out.where(F.col("start") >= F.col("end")).isEmpty()
    assert paragraphs.repeats(df.limit(0)).isEmpty()


def rows_of(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(paragraphs.repeats(df).collect(), key=lambda r: (r.doc_id, r.start))


def wrapped(text, k):
    words = text.split(" ")
    return "\n".join(" ".join(words[i : i + k]) for i in range(0, len(words), k))


def test_repeats_over_line_ends(spark):
    copy, passage = prose(160, 5), prose(60, 6)
    texts = {1: wrapped(copy, 15), 2: wrapped(copy, 16), 3: wrapped(prose(50, 7) + " " + passage, 11), 4: wrapped(passage + " " + prose(33, 8), 23), 5: wrapped(prose(200, 9), 12)}
    got = rows_of(spark, texts)
    assert [(r.doc_id, r.n_words, r.component_id, r.kept) for r in got] == [(1, 160, 1, True), (2, 160, 1, False), (3, 60, 3, True), (4, 60, 3, False)]
    for r, want in zip(got, [copy, copy, passage, passage]):
        assert texts[r.doc_id][r.start : r.end].split() == want.split() and texts[r.doc_id][: r.start].count("\n") == r.line


def test_passages_of_any_length_are_whole(spark):
    words = [f"w{i}" for i in range(40_000)]
    random.Random(1).shuffle(words)
    new = iter(words)
    take = lambda n: " ".join(next(new) for _ in range(n))
    texts, want = {}, {}
    for k, n in enumerate([25, 26, 30, 40, 51, 51, 51, 55, 55, 60, 60, 82, 100] * 4):
        passage = take(n)
        for d in (2 * k, 2 * k + 1):
            texts[d], want[d] = f"{take(70 + k)} {passage} {take(90)}", passage
    got = rows_of(spark, texts)
    assert [(r.doc_id, texts[r.doc_id][r.start : r.end], r.kept) for r in got] == [(d, p, d % 2 == 0) for d, p in want.items()]


def test_each_passage_keeps_an_occurrence(spark):
    a, b, c = prose(40, 61), prose(45, 62), prose(30, 63)
    inside = lambda k, *parts: " ".join([prose(70, 700 + k), *parts, prose(80, 800 + k)])
    texts = {1: inside(1, b), 2: inside(2, a, b), 3: inside(3, a), 4: inside(4, c, a, b), 5: inside(5, c, a), 6: wrapped(inside(6, b, c), 9)}
    got = rows_of(spark, texts)
    left = {d: t for d, t in texts.items()}
    for r in sorted(got, key=lambda r: -r.start):
        if not r.kept:
            left[r.doc_id] = left[r.doc_id][: r.start] + left[r.doc_id][r.end :]
    for part in (a, b, c):
        assert sum(part in " ".join(t.split()) for t in left.values()) == 1
    assert all(any(k.doc_id == r.component_id and k.kept for k in got) for r in got)


def test_links_of_a_crowded_bucket_are_all_found(spark):
    words = prose(120, 31).split(" ")
    change = lambda w, *at: " ".join("other" + str(i) if i in at else x for i, x in enumerate(w))
    texts = {1: " ".join(words), 2: change(words, 60), 90: change(words, 60, 20), 91: change(words, 60, 20, 100), 95: change(words, 60, 20, 100, 80)}
    texts |= {i: prose(120, 4000 + i) for i in range(10, 60)}
    sets = {u: paragraphs.shingles(t) for u, t in texts.items()}
    want = {u: u for u in texts}
    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) >= paragraphs.LIKE * len(sets[a] | sets[b]):
                join(want, a, b)
    table = spark.createDataFrame([(-1, u, t) for u, t in texts.items()], "piece int, uid long, text string")
    distinct = spark.createDataFrame([(u, [7]) for u in texts], "uid long, bands array<long>")
    found = paragraphs.links(table, distinct, paragraphs.Steps(spark)).collect()
    assert all(len(sets[e.a] & sets[e.b]) >= paragraphs.LIKE * len(sets[e.a] | sets[e.b]) for e in found)
    got = {u: u for u in texts}
    for e in found:
        join(got, e.a, e.b)
    assert len(sets[1] & sets[95]) < paragraphs.LIKE * len(sets[1] | sets[95])
    assert {u: root(got, u) for u in texts} == {u: root(want, u) for u in texts}
