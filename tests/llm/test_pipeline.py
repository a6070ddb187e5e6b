"""The pipeline against a plain version of all its stages."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from barloom.llm import mixing, secret_scan, simhash, toxicity
from tests.llm.helpers import SCHEMA, join, odd_docs, root

LABELS = "doc_id long, quality int, toxic int"


def plain_stages(rows, model, tokenizer):
    """Rows (doc_id, text, lang, source, n_chars) after each stage; ids are different and not null."""
    one = [r for r, s in zip(rows, model.scores([r[1] or "" for r in rows])) if s < toxicity.THRESHOLD]
    prints = {r[0]: simhash.simhash(r[1]) for r in one}
    parent = {i: i for i in prints}
    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                join(parent, a, b)
    two = [r for r in one if root(parent, r[0]) == r[0]]
    three = []
    for r in two:
        text, at = "", 0
        for a, _, b, kind in sorted(plain_secrets(r[1] or "")):
            if b > at:
                text += (r[1][at:a] if a > at else "") + (f"[{kind}]" if a >= at else "")
                at = b
        text = None if r[1] is None else text + r[1][at:]
        three.append((r[0], text, r[2], r[3], r[4] if text is None else len(text)))
    four = plain_mix(three)
    five = []
    for r in four:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        five.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return one, two, three, four, five


def plain_secrets(text):
    """(start, place of the kind, end, kind) of every match of every kind, whatever trigrams it has."""
    for place, rule in enumerate(secret_scan.RULES):
        for m in re.finditer(rule.pattern, text, re.ASCII):
            if len(m[rule.group]) >= rule.least:
                yield m.start(), place, m.end(), rule.kind


def plain_mix(rows):
    """Documents in hash order, laid end to end twice over their source until the rounded target is met."""
    names = sorted({r[3] for r in rows if r[3] is not None}, key=lambda s: s.encode()) + ([None] if any(r[3] is None for r in rows) else [])
    size = {r[0]: len(re.findall(mixing.WORD, r[1] or "")) for r in rows}
    total = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, rest = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(total.values())
    while free and rest > 1e-9:
        gain = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        rest = 0.0
        for s, g in gain.items():
            target[s] += g
            if target[s] >= 2 * total[s]:
                rest += target[s] - 2 * total[s]
                target[s] = 2.0 * total[s]
                free.discard(s)
    out = []
    for n, s in enumerate(names):
        ramp, quota, at = (0.5, 0.0, -0.5)[n % 3], int(target[s] + 0.5), 0
        own = sorted((r for r in rows if r[3] == s), key=lambda r: int(hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()[:15], 16))
        for r in own:
            parts = [max(0, min(size[r[0]], quota - at - k * total[s])) for k in (0, 1)]
            for k, part in list(enumerate(parts))[: sum(p > 0 and 2 * p >= size[r[0]] for p in parts)]:
                done = min((at + k * total[s] + part / 2) / target[s], 1.0)
                time = done if ramp == 0 else (((1 - ramp) ** 2 + 4 * ramp * done) ** 0.5 - (1 - ramp)) / (2 * ramp)
                out.append((time, r[0], k, r))
            at += size[r[0]]
    return [x[3] for x in sorted(out, key=lambda x: x[:3])]


def test_rows_are_those_of_the_plain_version(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    plain = plain_stages([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in docs.collect()], model, tokenizer)
    at = docs
    for (name, stage), want in zip(pipeline.STAGES, plain[:4]):
        at = stage(spark, at, sf).cache()
        got = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in at.collect()]
        assert (got if name == "mixing sources" else sorted(got)) == (want if name == "mixing sources" else sorted(want)), name
    rows = pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, rows)) == sorted(plain[4])


def test_stages_of_odd_tables(spark, tmp_path):
    """Null ids, texts and sources, repeated rows, clashing columns: every stage ends and keeps what its docstring says."""
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(i, i % 2, i % 2) for i in range(14)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(pipeline.STAGES)
    docs = odd_docs(spark, True)
    kept = stage["toxicity"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {str(r) for r in kept.collect()} <= {str(r) for r in docs.collect()}
    lone = stage["simhash near-dedup"](spark, docs, str(tmp_path))
    assert lone.columns == docs.columns and lone.where("text is null or trim(text) = ''").count() == 1
    clean = stage["secret scans"](spark, docs, str(tmp_path))
    assert clean.count() == docs.count() and clean.where("text is null").count() == docs.where("text is null").count()
    assert clean.where("contains(text, 'abcdefghijklmnop') or contains(text, 'AKIA')").isEmpty()
    assert clean.where(F.col("n_chars") != F.char_length("text")).isEmpty()
    mixed = stage["mixing sources"](spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and mixed.where("text is null or trim(text) = ''").isEmpty()
    empty = spark.createDataFrame([], SCHEMA)
    for _, f in pipeline.STAGES:
        assert f(spark, empty, str(tmp_path)).isEmpty()


def test_only_the_last_folder_is_left(spark, sf):
    from pathlib import Path

    from barloom.session import shared_folder

    pipeline = pytest.importorskip("corpus_pipeline")
    before = set(Path(shared_folder(spark)).glob("barloom-pipeline-*"))
    pipeline.run(spark, sf)
    (new,) = set(Path(shared_folder(spark)).glob("barloom-pipeline-*")) - before
    assert [p.name for p in new.iterdir()] == [str(len(pipeline.STAGES) - 2)]
