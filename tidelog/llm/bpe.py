"""BPE encoding by backtracking over longest token matches, and decoding with an offset table.

A pass of an Aho-Corasick automaton finds the longest token at each
position of a word. Tokens are taken left to right; two neighbours are
compatible if merging their joint text in rank order leaves them apart. An
incompatible token gives way to its longest proper prefix, and a position
from which no token leads on is marked dead and never tried again. So each
position is settled once and the result equals that of the merges.

Decoding gathers the bytes of all ids from one buffer through offsets.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidelog.llm.common import map_texts, pick

END = "</w>"
#: Entries that a worker remembers, at most, of words, of chunks between white space, and of pairs.
REMEMBERED = 400_000

# Fixed values of the tokenizer file: contractions, letters, one digit, other signs; and what is done to a text before.
PIECES_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = regex.compile(PIECES_PATTERN)
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PIECES_PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# White space of Unicode; str.split() takes four control characters more.
SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
NOT_SPACE = re.compile("[\x1c-\x1f]")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary: itself, or the next from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in letters)
    return letters | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of a byte-level BPE vocabulary with word ends.

    It remembers up to the given number of words, chunks and pairs each, in
    two halves: when the younger one is full, the older one is forgotten.
    """

    def __init__(self, text: str, remembered: int = REMEMBERED):
        spec = json.loads(text)
        model = spec["model"]
        for name, known in (("normalizer", NORMALIZER), ("pre_tokenizer", PRE_TOKENIZER), ("decoder", None), ("post_processor", None)):
            if spec.get(name) != known:
                raise ValueError(f"this encoder doesn't know the file's {name}")
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        to_byte = {c: b for b, c in byte_letters().items()}

        def key(token: str) -> str:
            """A token as one sign a byte; a last byte that ends its word is 256 higher."""
            ends = token.endswith(END) and token != END
            signs = [chr(to_byte[c]) for c in (token[: -len(END)] if ends else token)]
            return "".join(signs[:-1]) + chr(ord(signs[-1]) + 256 * ends)

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        plain = [c + e for e in ("", END) for c in to_byte]
        names = plain + [left + right for left, right in merges]
        own = {name: i for i, name in enumerate(names)}
        if len(own) != len(names):
            raise ValueError("a token has more than one merge")
        self.first_merge = len(plain)
        self.pairs = {(own[a], own[b]): self.first_merge + i for i, (a, b) in enumerate(merges)}
        self.parts = [(i, i) for i in range(len(plain))] + [(own[a], own[b]) for a, b in merges]
        keys = [key(n) for n in names]
        by_key = {k: i for i, k in enumerate(keys)}
        self.lengths = [len(k) for k in keys]
        self.shorter = [next((by_key[k[:n]] for n in range(len(k) - 1, 0, -1) if k[:n] in by_key), -1) for k in keys]
        self.ids = [vocab[n] for n in names]
        self.longest = ahocorasick.Automaton()
        for k, i in by_key.items():
            self.longest.add_word(k, i)
        self.longest.make_automaton()
        named = {i: n for n, i in vocab.items()} | {i: n for n, i in self.special.items()}
        shown = [(named.get(i, "") + " ").encode() for i in range(max(named) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in shown])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.half = max(1, remembered // 2)
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.old_words, self.old_chunks, self.old_apart = {}, {}, {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges, in rank order, never join the texts of two neighbouring tokens."""
        known = self.apart.get((left, right))
        if known is not None:
            return known
        known = self.old_apart.get((left, right))
        if known is not None:
            return self._keep("apart", (left, right), known)
        a, b, bound, fits = left, right, len(self.ids), True
        while True:
            if self.pairs.get((a, b), bound) < bound:
                fits = False
                break
            if max(a, b) < self.first_merge:
                break
            # Undo the later merge, of equal ones that on the right; a joint merge counts only before it.
            if a > b:
                bound, a = a, self.parts[a][1]
            else:
                bound, b = b + 1, self.parts[b][0]
        return self._keep("apart", (left, right), fits)

    def _keep(self, name: str, key, value):
        """Remember a value as one of the younger half."""
        young = getattr(self, name)
        if len(young) >= self.half:
            setattr(self, f"old_{name}", young)
            young = {}
            setattr(self, name, young)
        young[key] = value
        return value

    def merge(self, key: str) -> list[int]:
        """Own tokens of one word."""
        best = [-1] * len(key)
        for end, token in self.longest.iter(key):
            best[end + 1 - self.lengths[token]] = token
        if best[0] >= 0 and self.lengths[best[0]] == len(key):
            return [best[0]]
        out, at, token = [], 0, best[0]
        dead = bytearray(len(key) + 1)
        while at < len(key):
            end = at + self.lengths[token]
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = best[at] if at < len(key) else -1
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= self.lengths[token]
        return out

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is not None:
            return found
        found = self.old_words.get(word)
        if found is None:
            signs = word.encode().decode("latin-1")
            own = self.merge(signs[:-1] + chr(ord(signs[-1]) + 256))
            found = np.array([self.ids[t] for t in own], dtype="<u4").tobytes()
        return self._keep("words", word, found) if len(word) <= 64 else found

    def chunk(self, chunk: str) -> bytes:
        """Ids of a text without white space."""
        found = self.chunks.get(chunk)
        if found is not None:
            return found
        found = self.old_chunks.get(chunk)
        if found is None:
            parts = self.split_special.split(chunk) if self.split_special and "<" in chunk else [chunk]
            out = []
            for part in parts:
                if part in self.special:
                    out.append(np.array([self.special[part]], dtype="<u4").tobytes())
                    continue
                if not part.isascii():
                    # Letters are lowered one by one, so a sigma that ends a word is like any other.
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                out += map(self.word, PIECES.findall(part.lower()))
            found = b"".join(out)
        return self._keep("chunks", chunk, found) if len(chunk) <= 64 else found

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text as unsigned 32-bit integers; none for null."""
        if not text:
            return np.zeros(0, dtype="<u4")
        chunks = SPACES.split(text) if NOT_SPACE.search(text) else text.split()
        return np.frombuffer(b"".join(map(self.chunk, chunks)), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens of ids with a space between them, in UTF-8."""
        if not len(ids):
            return b""
        start = self.offsets[ids]
        size = self.offsets[ids.astype(np.int64) + 1] - start
        before = np.cumsum(size) - size
        return self.bytes[np.repeat(start - before, size) + np.arange(before[-1] + size[-1])].tobytes()[:-1]


@lru_cache(maxsize=2)
def codec(text: str, remembered: int = REMEMBERED) -> Codec:
    return Codec(text, remembered)


def tokenizer_text(path: str) -> str:
    """The vocabulary file, read on the driver; its size is that of the vocabulary."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>), one row per document.

    Equal to the tokenizers library with the file at path, without added
    special tokens, truncation and padding. A null text has no ids.
    """
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_text(path))

    def work(doc_id, text):
        c = codec(spec.value)
        return {"doc_id": doc_id, "ids": [c.encode(t).astype(np.int32) for t in text]}

    schema = {"doc_id": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32()))}
    return map_texts(pick(docs, id_col, text_col), ["doc_id", "text"], work, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) from (doc_id, ids); null ids decode to an empty text."""
    spec = encoded.sparkSession.sparkContext.broadcast(tokenizer_text(path))

    def work(doc_id, ids):
        c = codec(spec.value)
        return {"doc_id": doc_id, "decoded": [c.decode(np.array(i or [], dtype="<u4")).decode() for i in ids]}

    return map_texts(encoded, ["doc_id", "ids"], work, {"doc_id": ("long", pa.int64()), "decoded": ("string", pa.string())})


def round_trip(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, remembered: int = REMEMBERED
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and ids if asked for: each text encoded and decoded in one pass.

    A null text counts as empty; an empty table gives no rows. A worker
    remembers the ids of words up to a number, at about 200 bytes each; that
    bears on time only.
    """
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_text(path))

    def work(doc_id, text):
        c = codec(spec.value, remembered)
        ids = [c.encode(t) for t in text]
        return {
            "doc_id": doc_id,
            "n_tokens": [len(i) for i in ids],
            "ids_sha256": [hashlib.sha256(i.tobytes()).hexdigest() for i in ids],
            "decoded_sha256": [hashlib.sha256(c.decode(i)).hexdigest() for i in ids],
        } | ({"ids": [i.astype(np.int32) for i in ids]} if with_ids else {})

    schema = {
        "doc_id": ("long", pa.int64()),
        "n_tokens": ("long", pa.int64()),
        "ids_sha256": ("string", pa.string()),
        "decoded_sha256": ("string", pa.string()),
    } | ({"ids": ("array<int>", pa.list_(pa.int32()))} if with_ids else {})
    return map_texts(pick(docs, id_col, text_col), ["doc_id", "text"], work, schema)
