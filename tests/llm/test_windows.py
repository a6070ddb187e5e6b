"""Passages of a block of documents against a plain restatement, word by word; bands; what both cost."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import paragraphs
from barloom.llm.paragraphs import SHINGLE, WORDS, Tokens

PARAGRAPHS = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int32()), ("uid", pa.int64()), ("kept", pa.bool_()), ("least", pa.bool_())]))
FOUND = pa.list_(pa.struct([("k", pa.int32()), ("n", pa.int64()), ("keeper", pa.int64()), ("keeper_t", pa.int64()), ("keeper_at", pa.int32())]))
BLOCKS = pa.list_(pa.struct([("doc_id", pa.int64()), ("t", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("found", FOUND)]))


def batch_of(rows):
    kinds = [pa.int64(), pa.string(), BLOCKS, PARAGRAPHS]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "text", "blocks", "paragraphs"])


def hashed(words, a, b):
    return int(Tokens([" ".join(words)]).uid(np.array([a]), np.array([b]))[0])


def random_row(rng):
    n = rng.choice([0, 3, 30, 80, 200])
    words = [rng.choice("aß") + str(rng.randint(0, 9)) for _ in range(n)]
    text = "".join(w + rng.choice([" ", " ", "\n", "  "]) for w in words)
    doc_id, own, blocks = rng.choice([None, 1, 2, 3]), [], []
    for _ in range(rng.randint(0, 3) if n else 0):
        a = rng.randrange(n)
        b = min(n, a + rng.randint(1, 60))
        start = len(text) - len(text.split(None, a)[-1]) if a else 0
        own.append({"start": start, "words": b - a + rng.choice([0, 0, 0, 500]), "uid": hashed(words, a, b) + rng.choice([0, 0, 0, 1]), "kept": rng.random() < 0.4, "least": rng.random() < 0.5})
    for _ in range(rng.randint(0, 5) if n >= WORDS else 0):
        at = rng.randint(0, n - WORDS)
        size, t = rng.randint(1, n - WORDS - at + 1), rng.randint(0, 2)
        ks = [-1] if rng.random() < 0.5 else sorted(rng.sample(range(size), rng.randint(0, size)))
        keeper = lambda k: {"keeper": rng.choice([doc_id, doc_id, None, 2]), "keeper_t": rng.choice([t, 1]), "keeper_at": at + max(k, 0) + rng.choice([0, 0, 0, 1])}
        blocks.append({"doc_id": doc_id, "t": t, "at": at, "size": size, "found": [{"k": k, "n": rng.randint(2, 4)} | keeper(k) for k in ks]})
    return doc_id, text, blocks, rng.choice([own, own, own, None])


def plain_windows(text, blocks, own):
    words = text.lower().split()
    covered, gone, stays = ([False] * len(words) for _ in range(3))
    starts = np.array([m.start() for m in re.finditer(r"\S+", text)])
    for p in own or ():
        a = int(np.searchsorted(starts, p["start"]))
        b = a + p["words"]
        if b <= len(words) and hashed(words, a, b) == p["uid"]:
            for i in range(a, b):
                covered[i], gone[i], stays[i] = True, gone[i] or not p["kept"], stays[i] or p["kept"]
    out = []
    for b in blocks:
        for f in b["found"]:
            for k in range(b["size"]) if f["k"] < 0 else [f["k"]]:
                at = b["at"] + k
                kept = (f["keeper_t"], f["keeper"], f["keeper_at"] + (k if f["k"] < 0 else 0)) == (b["t"], b["doc_id"], at)
                if all(covered[at : at + WORDS]) and not (kept and any(gone[at : at + WORDS])):
                    continue
                lead = next((i for i in range(WORDS) if not stays[at + i]), WORDS)
                tail = next((i for i in range(WORDS) if not stays[at + WORDS - 1 - i]), WORDS)
                out.append({"at": at, "lead": lead, "tail": tail, "n": f["n"], "keeper": f["keeper"], "kept": kept})
    return sorted(out, key=lambda w: w["at"])


def plain_runs(found):
    left, at = [], 0
    while at < len(found):
        to = at + 1
        while to < len(found) and found[to]["at"] - found[to - 1]["at"] <= 1:
            to += 1
        edge = [w["n"] for w in found[at : min(to, at + SHINGLE)]]
        a = at + edge.index(max(edge))
        edge = [w["n"] for w in found[max(a, to - SHINGLE) : to][::-1]]
        left += found[a : to - edge.index(max(edge))]
        at = to
    runs = []
    for w in left:
        key, to = [w["keeper"], w["kept"]], w["at"] + WORDS
        end = to - (0 if w["kept"] else w["tail"])
        if runs and runs[-1][4] in (to, to - 1) and runs[-1][2:4] == key:
            runs[-1][1], runs[-1][4] = end, to
        else:
            runs.append([w["at"] + (0 if w["kept"] else w["lead"]), end, *key, to])
    for i, run in enumerate(runs):
        if not run[3]:
            run[0] = max([run[0], *[r[1] for r in runs[:i] if r[3]][-1:]])
            run[1] = min([run[1], *[r[0] for r in runs[i:] if r[3]][:1]])
    return [(b - a, keeper, kept, a) for a, b, keeper, kept, _ in runs if a < b]


def test_passages_are_those_of_a_plain_scan():
    rng, seen = random.Random(7), 0
    for _ in range(300):
        rows = [random_row(rng) for _ in range(rng.randint(1, 8))]
        got = [r for out in paragraphs._passage_batches(iter([batch_of(rows)])) for r in out.to_pylist()]
        want = []
        for doc_id, text, blocks, own in rows:
            starts = [m.start() for m in re.finditer(r"\S+", text)]
            want += [(doc_id, n, keeper, kept, starts[a]) for n, keeper, kept, a in plain_runs(plain_windows(text, blocks, own))]
        assert [(r["doc_id"], r["n_words"], r["component_id"], r["kept"], r["start"]) for r in got] == want
        seen += len(want)
    assert seen > 1000


@pytest.mark.parametrize("n, changed, like", [(60, 2, 0.724), (150, 3, 0.823), (400, 9, 0.805)])
def test_bands_meet_as_often_as_likeness_says(n, changed, like):
    rng, met, rounds = np.random.default_rng(11), 0, 600
    for _ in range(rounds):
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        b = a.copy()
        b[rng.choice(n, changed, replace=False)] ^= np.uint64(rng.integers(1, 1 << 40))
        keys = paragraphs._bands(paragraphs._mixed(np.concatenate([a, b])), np.array([0, n]), np.array([n, n]))
        met += bool((keys[0] == keys[1]).any())
    assert abs(met / rounds - (1 - (1 - like**paragraphs.ROWS) ** paragraphs.BANDS)) < 0.03


def test_one_run_costs_little_beside_reading_the_words():
    """CPU seconds of signatures, and of a text whose every window repeats, as a multiple of cutting the text into words."""
    rng = np.random.default_rng(3)
    vocabulary = np.array([f"word{i}" for i in range(5000)])
    texts = ["\n".join(" ".join(vocabulary[rng.integers(0, 5000, k)]) for k in (60, 90, 400, 30)) for _ in range(250)]
    rows = [(i, t, [{"doc_id": i, "t": 0, "at": 0, "size": 580 - WORDS + 1, "found": [{"k": k, "n": 2, "keeper": 0, "keeper_t": 0, "keeper_at": k} for k in range(580 - WORDS + 1)]}], []) for i, t in enumerate(texts)]
    batch = batch_of(rows)

    def cost(run):
        times = []
        for _ in range(4):
            began = time.process_time()
            run()
            times.append(time.process_time() - began)
        return min(times)

    words = cost(lambda: Tokens(texts))
    assert cost(lambda: paragraphs.units(list(range(len(texts))), texts)) < 3 * words
    assert cost(lambda: list(paragraphs._passage_batches(iter([batch])))) < 4 * words
