"""BPE encoding by a prefix-sharing trie, and decoding.

Byte-level BPE has two properties that make encodings of prefixes reusable. The encoding of
a string is known from its last token alone: what stands before that token is encoded as if
it were all there is. And a token sequence is an encoding exactly if every two neighbours
are, so a last token is right if it and the last token before it stay apart when merged by
rank. Each trie node (a prefix) therefore stores one last token; a word's ids are read off by
following last tokens back to the root. The distinct words of a block are put in trie order and
walked depth first, so a shared prefix is encoded once for all words that start with it.
Words met in earlier blocks are remembered, up to a bound.

The vocabulary file is a parameter; it is read where it is used and never copied.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import ship_package

#: Distinct pieces a worker remembers in each of two generations: bounds its memory.
MAX_WORDS = 200_000


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, and back.

    Printable bytes stand for themselves; the others, in order, for code points from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


Piece = str | tuple[str] | int


class TrieBpe:
    """Encoder and decoder of one byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        letter = byte_letters()
        spelled = {token: bytes(letter[c] for c in token) for token in model["vocab"]}
        self.of_bytes = {spelled[t]: i for t, i in model["vocab"].items()}
        self.bytes_of = {i: spelled[t] for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        vocab = model["vocab"]
        #: (left id, right id) -> (rank, merged id); and the pair that each merged id came from first.
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            key, made = (vocab[a], vocab[b]), vocab[a + b]
            self.merge.setdefault(key, (rank, made))
            self.parts.setdefault(made, (rank, *key))
        self.longest = max(map(len, self.of_bytes))
        self.apart: dict[tuple[int, int], bool] = {}
        # suffix search: bytes of a token read backwards lead from node to node
        self.back: list[dict[int, int]] = [{}]
        self.back_id: list[int] = [-1]
        usable = {i for i, (rank, a, b) in self.parts.items() if self.seam(a, b, rank)}
        for text, i in self.of_bytes.items():
            if i in self.parts and i not in usable:
                continue
            at = 0
            for b in reversed(text):
                nxt = self.back[at].get(b)
                if nxt is None:
                    nxt = self.back[at][b] = len(self.back)
                    self.back.append({})
                    self.back_id.append(-1)
                at = nxt
            self.back_id[at] = i
        self.lengths = {i: len(t) for i, t in self.bytes_of.items()}
        split = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"  # fixed value: the public pre-tokenizer pattern
        self.words = regex.compile(split).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.ids_of: dict[Piece, tuple[int, ...]] = {}
        self.older: dict[Piece, tuple[int, ...]] = {}
        self.names = [str(i) for i in range(max(self.bytes_of) + 1)]

    def seam(self, left: int, right: int, own: int | None = None) -> bool:
        """Whether merging by rank comes to exactly these two tokens.

        Undo merges along the seam, latest first. Whenever two pieces that touch at the seam
        have a merge of their own, it must come too late: not before the merge that consumed
        one of them (equal ranks go to the leftmost, which is the left side's). With ``own``
        the two tokens' own merge, of that rank, is allowed: then the answer is whether their
        union is ever made this way.
        """
        a, b, merge, parts = left, right, self.merge, self.parts
        limit, from_left = (1 << 60 if own is None else own), False
        met = merge.get((a, b)) if own is None else None
        while True:
            if met is not None and (met[0] < limit or (met[0] == limit and not from_left)):
                return False
            pa, pb = parts.get(a), parts.get(b)
            if pa is None and pb is None:
                return True
            # the later merge is undone first; of equal ranks the right side's came later
            if pb is None or (pa is not None and pa[0] > pb[0]):
                limit, from_left, a = pa[0], True, pa[2]
            else:
                limit, from_left, b = pb[0], False, pb[1]
            met = merge.get((a, b))

    def stays_apart(self, pair: tuple[int, int]) -> bool:
        """Whether two tokens can stand side by side in an encoding."""
        if len(self.apart) > 2 * MAX_WORDS:
            self.apart.clear()
        ok = self.apart[pair] = self.seam(*pair)
        return ok

    def last_token(self, word: bytes, depth: int, last: list[int]) -> int:
        """Last token of the prefix of ``depth`` bytes; ``last`` has those of the shorter prefixes."""
        back, back_id, apart = self.back, self.back_id, self.apart
        node, i = 0, depth
        while i:
            i -= 1
            node = back[node].get(word[i], -1)
            if node < 0:
                break
            token = back_id[node]
            if token >= 0:
                if i == 0:
                    return token
                pair = (last[i], token)
                ok = apart.get(pair)
                if self.stays_apart(pair) if ok is None else ok:
                    return token
        raise ValueError("vocabulary lacks a byte")

    def walk(self, words: list[bytes]) -> Iterator[tuple[int, ...]]:
        """Ids of sorted distinct words, by a depth-first walk of their trie.

        Sorted words visit their trie depth first, so the trie needs no table: the path from
        the root to the word at hand is all that is kept, with the last token of each prefix
        on it. A word goes back to where it leaves its predecessor's path and on from there.
        """
        last: list[int] = [-1]
        before = b""
        lengths, last_token = self.lengths, self.last_token
        for word in words:
            same = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                same += 1
            del last[same + 1 :]
            for depth in range(same + 1, len(word) + 1):
                last.append(last_token(word, depth, last))
            before = word
            ids, depth = [], len(word)
            while depth:
                token = last[depth]
                ids.append(token)
                depth -= lengths[token]
            yield tuple(reversed(ids))

    def chunks(self, text: str) -> list[Piece]:
        """Cut a text where no pre-token can cross: before a space between two other characters.

        Such a space starts the pre-token after it. Texts in which white space touches white
        space are cut into pre-tokens instead. Either way the ids of the parts, joined, are the text's.
        """
        if len(" ".join(text.split())) != len(text):
            return [(w,) for w in self.words(text)]
        out: list[Piece] = text.split(" ")
        out[0] = (out[0],)
        return out

    def pieces(self, text: str) -> list[Piece]:
        """Parts of a text in order. A string stands for itself after a space, a tuple for its string, a number for a special token."""
        if not text:
            return []
        if self.specials is None or not any(s in text for s in self.special):
            return self.chunks(text)
        out: list[Piece] = []
        for i, part in enumerate(self.specials.split(text)):
            if i % 2:
                out.append(self.special[part])
            elif part:
                out.extend(self.chunks(part))
        return out

    def known(self, pieces: list[list[Piece]]) -> dict[Piece, tuple[int, ...]]:
        """Ids of every piece of a block. Pieces met before are looked up, the others walked."""
        if len(self.ids_of) > MAX_WORDS:
            self.ids_of, self.older = {}, self.ids_of
        ids_of, older = self.ids_of, self.older
        new = set().union(*pieces)
        new.difference_update(ids_of.keys())
        cut: dict[Piece, list[str]] = {}
        for p in new:
            if p in older:
                ids_of[p] = older[p]
            elif isinstance(p, int):
                ids_of[p] = (p,)
            else:
                cut[p] = self.words(" " + p if isinstance(p, str) else p[0])
        words = {w.encode("utf-8", "surrogatepass"): w for found in cut.values() for w in found}
        order = sorted(words)
        walked = {words[raw]: ids for raw, ids in zip(order, self.walk(order))}
        for p, found in cut.items():
            ids_of[p] = walked[found[0]] if len(found) == 1 else tuple(i for w in found for i in walked[w])
        return ids_of

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        cut = [self.pieces(t) for t in texts]
        ids_of = self.known(cut)
        return [list(chain.from_iterable(map(ids_of.__getitem__, part))) for part in cut]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        of = self.bytes_of
        return b"".join([of[i] for i in ids]).decode("utf-8", "replace")


_ENCODERS: dict[str, TrieBpe] = {}


def encoder(path: str) -> TrieBpe:
    """The worker's encoder of a vocabulary file, kept for later blocks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieBpe(path)
    return _ENCODERS[path]


#: Code points whose words are learnt together.
BLOCK_CHARS = 2_000_000


def _blocks(texts: pd.Series) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        t = "" if t is None else t
        block.append(t)
        size += len(t)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (array of int) to each row; null text counts as empty, no ids.

    A column called ids is replaced; others pass through. Special tokens in a text become
    their ids, as the tokenizers library does by default.
    """
    ship_package(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(path)
        for part in parts:
            yield pd.Series([x for block in _blocks(part) for x in bpe.encode_batch(block)], dtype=object)

    return docs.withColumn("ids", ids(text))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded`` (string) from ``ids``; null ids give an empty string."""
    ship_package(encoded.sparkSession)

    @F.pandas_udf("string")
    def back(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(path)
        for part in parts:
            yield pd.Series([bpe.decode([] if x is None else x.tolist()) for x in part], dtype=object)

    return encoded.withColumn("decoded", back("ids"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row for every row of ``docs``.

    Encodes, decodes the ids and hashes both in one pass, so that no id leaves the worker.
    """
    ship_package(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def hashes(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path)
        for part in parts:
            rows = []
            for block in _blocks(part):
                for ids in bpe.encode_batch(block):
                    rows.append((len(ids), sha256(",".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest(), sha256(bpe.decode(ids).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", hashes("text").alias("h")).select("doc_id", "h.*")
