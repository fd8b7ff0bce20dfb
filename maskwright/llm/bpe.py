"""Byte-pair encoding by a tokenization automaton compiled from the merges, and decoding by its arc labels."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import lean_map, only

#: Words of which a worker keeps the encoding.
CACHED = 400_000


def byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies write bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}


class Automaton:
    """The deterministic automaton of a byte-pair vocabulary.

    Merge gadgets are applied to the one-state automaton of all strings, in the order of the merges. The gadget of (u, v) gives
    every state with a u-arc and then a v-arc an arc uv to where they lead, and turns the u-arcs to a copy of their target
    without the v-arc. So all arcs of one token lead to one state, which is named by the token, and that of uv starts as what the
    state of v is at that time: as a copy of v's without the arcs that gadgets before it took.

    A gadget takes from the state of u the v-arc, and with it all arcs that are added later by way of that arc: those of the tokens
    that begin with v and are made after it. Tokens are numbered by a walk through the tree of first parts, later ones last, so
    these are v and one range of numbers. A state's row of the transition table is therefore kept as the ranges of labels that it
    has no arc for (:meth:`row`): those of its own gadgets, and of the states it was copied from up to the copy. For 49,000 tokens
    that are some 1.6 million numbers, where a table of all pairs would have 2.4 thousand million.

    Symbols are bytes, and bytes that end a word, which are 256 higher. Each merge must be able to apply when its turn comes, as
    in a trained vocabulary.
    """

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        letters = byte_letters()
        self.left, self.right, self.time, self.merged = {}, {}, {}, {}
        spelled: dict[int, tuple[int, ...]] = {}
        self.byte = {}
        for c, b in letters.items():
            for text, symbol in ((c, b), (c + end, b + 256)):
                if text in vocab:
                    self.byte[symbol] = vocab[text]
                    spelled[vocab[text]] = (symbol,)
        for when, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            u, v, uv = vocab[a], vocab[b], vocab[a + b]
            if uv in self.time:
                raise ValueError(f"two merges make {a + b!r}")
            self.left[uv], self.right[uv], self.time[uv], self.merged[u, v] = u, v, when, when
            spelled[uv] = spelled[u] + spelled[v]
        # the scanner: a trie of all tokens with the usual links, so that each symbol is one transition
        self.next: list[dict[int, int]] = [{}]
        token = [-1]
        for t, symbols in spelled.items():
            at = 0
            for s in symbols:
                if s not in self.next[at]:
                    self.next[at][s] = len(self.next)
                    self.next.append({})
                    token.append(-1)
                at = self.next[at][s]
            token[at] = t
        self.fail, self.longest, self.size = [0] * len(self.next), list(token), {t: len(s) for t, s in spelled.items()}
        self.shorter: dict[int, int] = {}
        queue = list(self.next[0].values())
        for t in (token[x] for x in queue):
            self.shorter[t] = -1
        for at in queue:
            for s, to in self.next[at].items():
                f = self.fail[at]
                while f and s not in self.next[f]:
                    f = self.fail[f]
                self.fail[to] = self.next[f].get(s, 0)
                below = self.longest[self.fail[to]]
                if token[to] >= 0:
                    self.shorter[token[to]] = below
                else:
                    self.longest[to] = below
                queue.append(to)
        self._number(spelled)

    def _number(self, spelled: dict[int, tuple[int, ...]]) -> None:
        """Numbers the labels, and lists for each token the ranges that the gadgets with it as first part take, in their order."""
        after: dict[int, list[int]] = {t: [] for t in spelled}
        for uv, u in self.left.items():  # in the order of time
            after[u].append(uv)
        self.place, stop, n = {}, {}, 0
        stack = [(t, False) for t in spelled if t not in self.left]
        while stack:
            t, done = stack.pop()
            if done:
                stop[t] = n
                continue
            self.place[t], n = n, n + 1
            stack.append((t, True))
            stack += [(c, False) for c in reversed(after[t])]
        made = {t: [self.time[c] for c in cs] for t, cs in after.items()}
        taken: dict[int, list[tuple[int, int, int]]] = {}
        for (u, v), when in self.merged.items():
            later = bisect_left(made[v], when)
            first = self.place[after[v][later]] if later < len(after[v]) else stop[v]
            taken.setdefault(u, []).extend([(when, self.place[v], self.place[v] + 1), (when, first, stop[v])])
        self.taken = {u: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for u, r in taken.items()}
        self.rows = {t: self.row(t) for t in spelled}
        del self.left, self.right, self.time, self.merged, self.taken  # a worker keeps what encoding needs only

    def row(self, token: int) -> array:
        """The bounds, in order, of the ranges of label numbers for which the state of ``token`` has no arc."""
        low, high = [], []
        t, limit = token, sys.maxsize
        while True:
            if t in self.taken:
                when, a, b = self.taken[t]
                n = int(np.searchsorted(when, limit))  # the copy was made then
                low.append(a[:n])
                high.append(b[:n])
            if t not in self.right:
                break
            t, limit = self.right[t], min(limit, self.time[t])
        if not low:
            return array("i")
        low, high = np.concatenate(low), np.concatenate(high)
        some = low < high
        low, high = low[some], high[some]
        order = np.argsort(low, kind="stable")
        low, high = low[order], np.maximum.accumulate(high[order])
        new = np.concatenate((np.ones(min(1, len(low)), bool), low[1:] > high[:-1]))
        last = np.concatenate((new[1:], np.ones(min(1, len(low)), bool)))
        return array("i", np.stack([low[new], high[last]], axis=1).reshape(-1).tolist())

    def has_arc(self, token: int, label: int) -> bool:
        """Whether ``label`` may follow ``token``: the state of token has that arc after all gadgets."""
        return not bisect_right(self.rows[token], self.place[label]) & 1

    def encode(self, word: bytes) -> list[int]:
        """The tokens of a word: at each symbol, the longest token to end there that the state before it has an arc for."""
        n = len(word)
        last = [-1] * (n + 1)
        at = 0
        nxt, fail, longest, size, shorter, rows, place = self.next, self.fail, self.longest, self.size, self.shorter, self.rows, self.place
        for i in range(1, n + 1):
            s = word[i - 1] + 256 * (i == n)
            while at and s not in nxt[at]:
                at = fail[at]
            at = nxt[at].get(s, 0)
            t = longest[at]
            while (k := size[t]) < i:
                if not bisect_right(rows[last[i - k]], place[t]) & 1:
                    break
                t = shorter[t]
            last[i] = t
        out = []
        while n:
            out.append(last[n])
            n -= size[last[n]]
        return out[::-1]


#: White space as the tokenizer's pattern has it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: Letters and numbers that are newer than Python's own tables.
_NEWER = {
    "L": (
        "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E "
        "11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0 "
    ),
    "N": (
        "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA "
    ),
}
#: Capitals that are newer than Python's own tables.
_NEW = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_NEW |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_ANY_NEW = re.compile("[" + "".join(map(chr, _NEW)) + "]")


def lower(text: str) -> str:
    """Lower case letter by letter, so that no letter depends on its place in the word."""
    if not text.isascii():
        text = text.replace("Σ", "σ")
        if _ANY_NEW.search(text):
            text = text.translate(_NEW)
    return text.lower()


@lru_cache(4)
def _pieces(top: int):
    """Finds the pieces of a text without characters beyond ``top``: small classes are looked up much faster."""
    classes = []
    for kind, newer in _NEWER.items():
        found = {c for c in range(top + 1) if unicodedata.category(chr(c))[0] == kind}
        for x in newer.split():
            lo, _, hi = x.partition("-")
            found |= {c for c in range(int(lo, 16), int(hi or lo, 16) + 1) if c <= top}
        starts, ends = sorted(c for c in found if c - 1 not in found), sorted(c for c in found if c + 1 not in found)
        classes.append("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True)))
    letters, numbers = classes
    return re.compile(f"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[{numbers}]|[^{SPACE}{letters}{numbers}]+").findall


def pieces(text: str) -> list[str]:
    """Contractions, runs of letters, single numbers, runs of anything else but white space."""
    if text.isascii():
        return _pieces(0x7F)(text)
    try:
        text.encode("latin-1")
        return _pieces(0xFF)(text)
    except UnicodeEncodeError:
        return _pieces(0xFFFF if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else sys.maxunicode)(text)


class Codec:
    """A tokenizer file of the kind lower case, bytes, word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model = j["model"]
        kinds = [x["type"] for x in j["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not model["end_of_word_suffix"] or j["decoder"]:
            raise ValueError(f"{path} is not of the kind this codec is for")
        self.labels = {i: t for t, i in model["vocab"].items()} | {x["id"]: x["content"] for x in j["added_tokens"]}
        self.labels = [self.labels.get(i, "") for i in range(max(self.labels) + 1)]
        self.special = {x["content"]: x["id"] for x in j["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.automaton = Automaton(model["vocab"], model["merges"], model["end_of_word_suffix"])
        codec = self

        class Words(dict):
            def __missing__(self, piece: str) -> bytes:
                if len(self) >= CACHED:
                    self.clear()
                ids = codec.automaton.encode(piece.encode("utf-8", "replace"))
                self[piece] = out = np.array(ids, "<u4").tobytes()
                return out

        self.word = Words().__getitem__

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.word, pieces(lower(unicodedata.normalize("NFC", text)))))

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if "<|" not in text:
            return self._plain(text)
        parts = self.at_special.split(text)
        return b"".join(self.special[x].to_bytes(4, "little") if n % 2 else self._plain(x) for n, x in enumerate(parts))

    def decode(self, ids: bytes | np.ndarray) -> str:
        """The labels of the ids, with spaces between them."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(1)
def codec(path: str) -> Codec:
    """The codec of a file, compiled once in each worker."""
    return Codec(path)


def _mapped(df: DataFrame, make, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                yield make(b.slice(lo, 200))

    return lean_map(df, run, schema, keep=True)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` of each row. Null and empty texts have no ids; repeated rows, null ids and further columns do no
    harm; the file at ``path`` must be there on every executor."""

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.frombuffer(codec(path).encode(t), "<i4") for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    plain = only(docs, id_col, text_col).withColumnRenamed(id_col, "doc_id")
    return _mapped(plain, make, f"doc_id {dict(plain.dtypes)['doc_id']}, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of each row of ids; null ids give an empty text, an id outside the vocabulary is an error."""

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [codec(path).decode(np.array(x or [], "<u4")) for x in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    plain = only(tokens, id_col, ids_col).withColumnRenamed(id_col, "doc_id")
    return _mapped(plain, make, f"doc_id {dict(plain.dtypes)['doc_id']}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: :func:`encode` and :func:`decode` of each text, as digests."""

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        c, n, ids_sha, text_sha = codec(path), [], [], []
        for t in b.column(1).to_pylist():
            ids = c.encode(t)
            n.append(len(ids) // 4)
            ids_sha.append(sha256(ids).hexdigest())
            text_sha.append(sha256(c.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    plain = only(docs, id_col, text_col).withColumnRenamed(id_col, "doc_id")
    return _mapped(plain, make, f"doc_id {dict(plain.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded."""
    return digests(only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), vocabulary())
