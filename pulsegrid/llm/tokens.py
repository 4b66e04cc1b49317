"""Byte-level BPE: ids from the tokenizers library with a cache of words, and token counts by rank-synchronous merging."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A blank that white space or the text's end follows. Where there is none, each blank begins a pre-token that does not
#: depend on what stands before it, so the text can be cut at its blanks.
_UNSAFE = re.compile(r" (?=\s|\Z)")
#: Where there is none of these either, commas, full stops and line feeds begin pre-tokens in the same way.
_JOINED = re.compile(r"[^\w\n][.,]|_[.,]|\n(?=\s|\Z)|\0")
#: Cached words of one worker; the cache is emptied when it is full. Words over LONG_WORD characters are not kept.
CACHED, LONG_WORD = 1_500_000, 200
#: Bytes of text that a worker cuts at once; a longer text comes alone.
BATCH_BYTES = 8 << 20


def vocabulary_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordCache:
    """Values of whole texts as sums of the values of their words; subclasses say what a pre-token's value is.

    A text is cut at its blanks where that changes no pre-token (see _UNSAFE); the words of a batch that the worker has not
    met are valued together. Other texts, and those with strings of special tokens, are valued whole.
    """

    special: list[str] = []
    cuts = True
    def __init__(self):
        self.cache: dict = {}
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")

    def values(self, words: list[str]) -> list:
        """Of words (with the blank before them, if there is one); each is made of whole pre-tokens."""
        raise NotImplementedError

    def whole(self, text: str):
        raise NotImplementedError

    def total(self, values: list):
        raise NotImplementedError

    def parts(self, text: str) -> list[str] | None:
        """The text cut where pre-tokens begin, or None if it can't be cut; a part holds whole pre-tokens."""
        if not self.cuts or _UNSAFE.search(text) or self.at_special.search(text):
            return None
        if not _JOINED.search(text):
            text = text.replace(",", "\0,").replace(".", "\0.").replace("\n", "\0\n")
        elif "\0" in text:
            return None
        return text.replace(" ", "\0 ").split("\0")

    def batch(self, texts: list[str | None]) -> list:
        cache = self.cache
        if len(cache) > CACHED:
            cache.clear()
        cut = [self.parts(t) if t else [] for t in texts]
        new = set()
        for p in cut:
            if p:
                new.update(p)
        new.difference_update(cache.keys())
        words = list(new)
        cache.update(zip(words, self.values(words), strict=True))
        out = [self.whole(t) if p is None else self.total([cache[w] for w in p]) for t, p in zip(texts, cut, strict=True)]
        for w in words:
            if len(w) > LONG_WORD:
                del cache[w]
        return out


class Encoder(WordCache):
    """ids of whole texts as the tokenizers library gives them, without added special tokens; little-endian unsigned integers of `width` bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        self.special = [x["content"] for x in spec["added_tokens"]]
        super().__init__()
        pre = spec["pre_tokenizer"] or {}
        self.cuts = pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"] and not spec["normalizer"]
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.letters = dict(enumerate(byte_letters()))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind)

    def whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def values(self, words: list[str]) -> list[bytes]:
        out, odd = {}, []
        model, letters, kind = self.tok.model.tokenize, self.letters, "H" if self.width == 2 else "I"
        for w in words:
            if w.isalpha() or (w[:1] == " " and w[1:].isalpha()):  # one pre-token: straight to the model
                out[w] = array(kind, [t.id for t in model(w.encode().decode("latin-1").translate(letters))]).tobytes()
            else:
                odd.append(w)
        for i in range(0, len(odd), 4096):
            some = odd[i : i + 4096]
            for w, e in zip(some, self.tok.encode_batch_fast(some, add_special_tokens=False), strict=True):
                out[w] = array(kind, e.ids).tobytes()
        return [out[w] for w in words]

    def total(self, values):
        return b"".join(values)


class RankMerger(WordCache):
    """Counts the symbols that byte-pair merging leaves of each pre-token, for all pre-tokens of a batch at once."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            raise ValueError("a byte-level BPE vocabulary is needed")
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = len(vocab) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        self.byte = np.array([vocab[c] for c in byte_letters()], dtype=np.int32)
        self.special = [x["content"] for x in spec["added_tokens"]]
        super().__init__()
        # The split of byte-level BPE vocabularies, a fixed value.
        self.pattern = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

    def symbols(self, tokens: list[bytes]) -> np.ndarray:
        """The number of symbols each pre-token ends with. One round merges, in every sequence, all places of its lowest-ranked pair."""
        lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        result = lengths.copy()
        flat = self.byte[np.frombuffer(b"".join(tokens), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(tokens)), lengths)
        none = np.int32(2**31 - 1)
        while len(flat) > 1:
            pair = flat[:-1].astype(np.int64) * self.size + flat[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.append(np.where((self.keys[at] == pair) & (seq[:-1] == seq[1:]), self.rank[at], none), none)
            starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            low = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(flat)))
            lowest = np.repeat(low, sizes)
            hit = np.flatnonzero((rank == lowest) & (lowest != none))
            if not len(hit):
                break
            # In a run of overlapping places (x x x) every second one merges, from the left.
            start = np.append(True, (np.diff(hit) != 1) | (seq[hit[1:]] != seq[hit[:-1]]))
            nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))
            hit = hit[nth % 2 == 0]
            flat[hit] = self.made[rank[hit]]
            np.subtract.at(result, seq[hit], 1)
            stay = lowest != none
            stay[hit + 1] = False
            flat, seq = flat[stay], seq[stay]
        return result

    def values(self, words: list[str]) -> list[int]:
        split = [(w,) if w.isalpha() or (w[:1] == " " and w[1:].isalpha()) else self.pattern.findall(w) for w in words]
        pieces = list(dict.fromkeys([p for s in split for p in s]))
        n: dict[str, int] = {}
        for i in range(0, len(pieces), 1 << 16):
            some = pieces[i : i + (1 << 16)]
            n.update(zip(some, self.symbols([p.encode() for p in some]).tolist(), strict=True))
        return [sum([n[p] for p in s]) for s in split]

    def whole(self, text: str) -> int:
        got = self.at_special.split(text)
        return len(got) - 1 + sum(self.values([x for x in got if x]))

    def total(self, values):
        return sum(values)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next free one from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


_made: dict = {}


def made(kind: type, path: str):
    """One encoder for each worker process; later tasks use its cache again."""
    if (kind, path) not in _made:
        _made[kind, path] = kind(path)
    return _made[kind, path]


def release() -> None:
    """Drops the encoders of this worker process with their caches; a task that needs none of them gives their memory back."""
    _made.clear()


def chunks(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterable[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def by_chars(batches: Iterable[pa.RecordBatch], column: int, most: int, rows: int = 1024) -> Iterable[pa.RecordBatch]:
    """Slices of at most `rows` rows whose texts (or bytes) in a column are at most `most` bytes together; a longer one comes alone."""
    for b in batches:
        sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in b.column(column)], dtype=np.int64)
        start = 0
        while start < b.num_rows:
            upto = np.cumsum(sizes[start : start + rows])
            n = max(1, int(np.searchsorted(upto, most, side="right")))
            yield b.slice(start, n)
            start += n


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, path: str | None = None) -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Texts are cut at blanks where that changes no pre-token; the distinct pre-tokens of a batch are merged together as one
    ragged array, and a worker remembers their counts. Null and empty texts have no bytes and no tokens. Strings of special
    tokens inside a text count as one token, the library's default. Ids are carried through, also null and repeated ones; other
    columns are not read; no shuffle.
    """
    path = vocabulary_path(path)

    def count(batches):
        merger = made(RankMerger, path)
        for b in by_chars(batches, 2, BATCH_BYTES, 512):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(merger.batch(b.column(2).to_pylist()), pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
