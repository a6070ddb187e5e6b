"""Operators without SQL against slow, plain restatements."""

import html as markup
import math
import re
from html.parser import HTMLParser

import numpy as np
import pytest

from barloom.llm import avi, html_text, media, paragraphs, quality, toxicity
from tests.llm.helpers import ODD, prose

M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def spaced(text):
    return " " + " ".join(text.split()) + " "


def gram_bucket(gram, bits):
    h = (ord(gram[0]) * 16777619 + 7) & M32
    for c in gram[1:]:
        h = (h * 16777619 & M32) ^ ord(c)
    x = h * 2654435761 & M32
    return ((x ^ x >> 15) * 2654435761 & M32) >> 32 - bits


def plain_grams(text, least, most, bits):
    """(bucket of) every n-gram that does not cross the text's ends."""
    t = spaced(text)
    return [gram_bucket(t[i : i + n], bits) for n in range(least, most + 1) for i in range(len(t) - n + 1)]


def sigmoid(z):
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


TEXTS = [prose(40, 1), "two two three", "Ümläut ß 日本語のテキスト 🙂", "", " \n ", *[t for t in ODD if t and len(t) < 300]]


def test_toxicity_scores():
    rng = np.random.default_rng(3)
    weights = rng.normal(size=1 << toxicity.BITS) * (rng.random(1 << toxicity.BITS) < 0.3)
    want = [sigmoid(0.2 + sum(weights[b] for n in range(toxicity.LEAST, toxicity.MOST + 1) for b in set(plain_grams(t.lower(), n, n, toxicity.BITS)))) for t in TEXTS]
    assert toxicity.NbLinear(weights, 0.2).scores(TEXTS) == pytest.approx(want)


def word_hash(word):
    h = 0
    for c in reversed(word):
        h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & M64
    return h * 0x9E3779B97F4A7C15 & M64


def test_quality_scores():
    table = np.random.default_rng(4).normal(size=1 << quality.BITS)
    want = []
    for t in TEXTS:
        words = t.split()
        h = [int(quality.AGAIN) if i and words[i - 1] == w else word_hash(w) for i, w in enumerate(words)]
        bucket = lambda x: (x * 0x9E3779B97F4A7C15 & M64) >> 64 - quality.BITS
        found = plain_grams(t, quality.LEAST, quality.MOST, quality.BITS) + [bucket(x) for x in h] + [bucket(a * 0xBF58476D1CE4E5B9 + b & M64) for a, b in zip(h, h[1:])]
        want.append(sigmoid(sum(table[b] for b in found) / max(1, len(found)) + 0.1))
    assert quality.SubwordModel(table, 0.1).scores(TEXTS) == pytest.approx(want)


def test_shots_are_those_of_a_plain_scan():
    """The clip bounds of media.clips_of, from histograms made and compared one by one."""
    rng = np.random.default_rng(7)
    for _ in range(20):
        frames = [np.clip(rng.normal(rng.choice([40, 120, 220]) if i % 7 == 0 else 120, 20, (avi.SIDE, avi.SIDE)), 0, 255).astype(np.uint8) for i in range(30)]
        found = media.clips_of(10.0, frames)
        assert found[0][0] == 0 and found[-1][1] == len(frames) - 1 and all(a[1] + 1 == b[0] for a, b in zip(found, found[1:]))
        assert all(start == first / 10 and end == (last + 1) / 10 for first, last, start, end in found)
        counts = np.array([[int(((f >> 4) == k).sum()) for k in range(avi.BINS)] for f in frames])
        assert [(a, b) for a, b, _, _ in found] == avi.shots(counts)


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert html_text.extract(pages).isEmpty()
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert media.probe(docs).isEmpty() and media.clips(media.with_media(docs)).isEmpty()


class Words(HTMLParser):
    """All text outside of head, script, style and comments, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.closed, self.words = [], []

    def handle_starttag(self, tag, attributes):
        if tag in ("script", "style", "head", "title", "noscript", "template"):
            self.closed.append(tag)

    def handle_endtag(self, tag):
        if tag in self.closed:
            del self.closed[self.closed.index(tag) :]

    def handle_data(self, data):
        if not self.closed:
            self.words += data.split()


def test_pages_have_the_words_of_a_plain_parser(spark, sf):
    """Every word shown is one of the page's, in the page's order, and little but hidden text is missing."""
    shown = total = 0
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        parser = Words()
        parser.feed(r.html or "")
        ours = re.findall(r"\w+", html_text.visible_text(r.html))
        theirs = re.findall(r"\w+", " ".join(parser.words))
        at = iter(theirs)
        missing = [w for w in ours if not w.isdigit() and w not in set(theirs)]
        assert not missing, (r.page_id, missing[:5])
        kept = sum(any(w == x for x in at) for w in ours if w in set(theirs))
        assert kept >= 0.9 * len([w for w in ours if w in set(theirs)])
        shown += len(ours)
        total += len(theirs)
    assert shown >= 0.9 * total


def test_marks_do_not_change_plain_text():
    text = prose(50, 3)
    assert html_text.visible_text(f"<p>{markup.escape(text)}</p>").split() == text.split()


@pytest.fixture(scope="module")
def thousand():
    import os

    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("test tables are not here")
    return path


def test_passages_are_those_of_brute_force(spark, thousand):
    """All runs of 50 words that stand in two documents are covered by rows, whatever the lines; no row without a repeat; each keeps a place."""
    docs = spark.read.parquet(f"{thousand}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = {}
    for r in paragraphs.repeats(docs).collect():
        rows.setdefault(r.doc_id, []).append(r)
    long = 50
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    words = {d: [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", low(t))] for d, t in texts.items()}
    places = {}
    for d, found in words.items():
        for i in range(len(found) - long + 1):
            places.setdefault(tuple(w for w, _, _ in found[i : i + long]), []).append((d, i))
    repeated = [(d, i) for at in places.values() if len({d for d, _ in at}) > 1 for d, i in at]
    assert len(repeated) > 1000
    covered = {}
    for d, found in rows.items():
        mark = covered[d] = np.zeros(len(texts[d]) + 1, bool)
        for r in found:
            mark[r.start : r.end] = True
    whole = sum(all(covered.get(d, np.zeros(len(texts[d]) + 1, bool))[a:b].all() for _, a, b in words[d][i : i + long]) for d, i in repeated)
    assert whole >= 0.98 * len(repeated)
    # what rows call a passage does stand elsewhere: all its runs of 25 words
    runs = {}
    for d, found in words.items():
        for i in range(len(found) - paragraphs.WORDS + 1):
            runs.setdefault(tuple(w for w, _, _ in found[i : i + paragraphs.WORDS]), set()).add((d, i))
    for d, found in rows.items():
        for r in found:
            if r.kind == "passage" and r.n_words >= paragraphs.WORDS:
                own = [w for w, a, b in words[d] if a >= r.start and b <= r.end]
                assert all(len(runs[tuple(own[k : k + paragraphs.WORDS])]) > 1 for k in range(len(own) - paragraphs.WORDS + 1))
    # following ``kept`` loses no repeated run that only passages, not near copies of paragraphs, cover
    left = {}
    for d, t in texts.items():
        gone = np.zeros(len(t) + 1, bool)
        for keep in (False, True):
            for r in rows.get(d, ()):
                if r.kept == keep:
                    gone[r.start : r.end] = not keep
        left[d] = gone
    near = {d: [r for r in found if r.kind == "paragraph"] for d, found in rows.items()}
    lost = seen = 0
    for at in places.values():
        if len({d for d, _ in at}) < 2:
            continue
        spans = [(d, words[d][i][1], words[d][i + long - 1][2]) for d, i in at]
        if any(r.start < b and a < r.end for d, a, b in spans for r in near.get(d, ())):
            continue
        seen += 1
        lost += all(left[d][a:b].any() for d, a, b in spans)
    assert seen > 100 and lost <= 0.02 * seen


def test_sketches_never_put_apart_what_is_like():
    rng = np.random.default_rng(2)
    texts = ["", "x y", "a a a a a a a b", "nb sp one two three four five six"]
    for i in range(40):
        words = prose(int(rng.integers(5, 90)), i).split()
        for _ in range(4):
            other = list(words)
            for _ in range(int(rng.integers(0, 4))):
                other[rng.integers(len(other))] = "z" + str(rng.integers(99))
            texts.append(" ".join(other))
    n, bits = paragraphs.sketches(texts)
    sets = [paragraphs.shingles(t) for t in texts]
    assert n.tolist() == [len(s) for s in sets]
    for i in range(len(texts)):
        for j in range(i):
            apart = sum(int(x).bit_count() for x in (bits[i] ^ bits[j]).view(np.uint64))
            assert apart <= len(sets[i] ^ sets[j])
            like = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            assert like < paragraphs.LIKE or apart * (1 + paragraphs.LIKE) <= (n[i] + n[j]) * (1 - paragraphs.LIKE) + 1e-6
