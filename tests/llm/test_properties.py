"""Properties that hold for any texts."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as s

from barloom.llm import avi, bpe, html_text, media, paragraphs, queries, secret_scan, simhash, trigrams

texts = s.text(s.characters(exclude_categories=["Cs"]), max_size=80)
tagged = s.lists(s.sampled_from(["<p>", "</p>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "</table>", "<b", "<!--", "-->", "x ", "&amp;", "<br>", "<script>", "</script>", "<div hidden>", "</div>", "\n"]), max_size=40).map("".join)


@pytest.fixture(scope="module")
def encoder():
    return bpe.TrieBpe(queries.byte_bpe_path())


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(s.lists(texts, max_size=5))
def test_decoding_undoes_encoding(encoder, many):
    assert [encoder.decode(ids) for ids in encoder.encode_batch(many)] == many


@settings(max_examples=100, deadline=None)
@given(s.lists(texts, min_size=1, max_size=5))
def test_media_undo_media(many):
    payloads = [media.payload_of(t) for t in many]
    back = media.read_back(media.store(payloads))
    assert [b"".join(f.tobytes() for f in frames) for _, frames in back] == payloads


@settings(max_examples=60, deadline=None)
@given(s.integers(0, 2**32 - 1), s.integers(1, 4))
def test_any_frame_is_lossless(seed, n):
    samples = np.random.default_rng(seed).integers(0, 256, (n, avi.SIDE, avi.SIDE), dtype=np.uint8)
    assert (np.array(avi.decode_frames([avi.parse_frame(f) for f in avi.encode_frames(samples)])) == samples).all()


@settings(max_examples=300, deadline=None)
@given(tagged)
def test_any_markup_gives_text(html):
    out = html_text.visible_text(html)
    assert "<p>" not in out and not out.startswith("\n") and not out.endswith("\n")


pieces = s.recursive(
    s.sampled_from(["a", "b", "cd", "[ab]", "x1", "."]), lambda p: s.one_of(s.tuples(p, p).map("".join), s.tuples(p, p).map(lambda t: f"(?:{t[0]}|{t[1]})"), p.map(lambda x: f"(?:{x})?"), p.map(lambda x: f"(?:{x})+"), p.map(lambda x: f"(?:{x}){{2,3}}")), max_leaves=8
)


@settings(max_examples=300, deadline=None)
@given(pieces, s.data())
def test_trigram_queries_miss_no_match(pattern, data):
    hit = data.draw(s.from_regex(pattern, fullmatch=True)).lower()
    query = trigrams.trigram_query(pattern)

    def holds(q) -> bool:
        return q is True or (q in hit if isinstance(q, str) else (all if q[0] == "and" else any)(map(holds, q[1:])))

    assert holds(query)


@settings(max_examples=200, deadline=None)
@given(s.lists(texts, min_size=1, max_size=6))
def test_scan_is_plain_matching(many):
    assert secret_scan.Scanner().scan(many) == [sorted((a, k, b) for k, r in enumerate(secret_scan.RULES) for a, b in r.spans(t)) for t in many]


@settings(max_examples=200, deadline=None)
@given(texts)
def test_fingerprints_ignore_white_space_and_case(text):
    ascii_upper = "".join(c.upper() if c.isascii() else c for c in text)
    ascii_lower = "".join(c.lower() if c.isascii() else c for c in text)
    assert simhash.simhash(ascii_upper) == simhash.simhash(ascii_lower) == simhash.simhash(f"  {ascii_lower}\n")


@settings(max_examples=150, deadline=None)
@given(s.lists(s.lists(s.sampled_from(["one", "Two", "drei", "quatre\n", "\n", "fünf", "🙂", "a\tb"]), max_size=90).map(" ".join), max_size=4))
def test_units_point_into_texts(many):
    for r in paragraphs.units(list(range(len(many))), many).to_pylist():
        own = many[r["doc_id"]][r["start"] : r["end"]]
        assert len(own.split()) == r["words"] and own == own.strip() and "\n" not in own
        assert many[r["doc_id"]][: r["start"]].count("\n") == r["line"]
        assert (r["text"] is None) == (r["piece"] >= 0) and (r["text"] is None or r["text"].split() == own.encode().lower().decode().split())
