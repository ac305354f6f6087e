"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the text's bytes cuts it into chunks, so passages that documents share become the same chunks
wherever they stand. A task encodes each distinct chunk once and keeps it in a cache bounded in bytes. A cut may fall
inside a word; the words at a join belong to neither chunk. A join is repaired by encoding it again with the last word
of the chunk before and the first of the chunk after; if the ids of those two words come out at its ends as they are in
the chunks, the ids between them are the join's, else more words are taken in on both sides, and at last the whole text.
Within a chunk, words come from a cache of encoded words, filled by the tokenizers library in bulk.

Encoding, decoding and digests are one pass in one Python worker, so a task slot holds one tokenizer and one set of
caches. A chunk that several tasks meet is encoded by each of them (README has the measured share): sharing the ids
would shuffle every document's pieces to spare that.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import map_texts

#: A chunk has so many bytes on average: a power of two.
CHUNK_BYTES = 1024
#: Bytes of a cache's young half, its entries' overhead included; when it is full it becomes the old half.
CACHED_WORDS = 24 << 20
CACHED_CHUNKS = 12 << 20
ENTRY_BYTES = 180
#: Texts worked on at a time, in bytes.
SLICE_BYTES = 1 << 20
#: Words given to the library at once.
BULK = 400
#: Most words on either side that a join is encoded with before the whole text is.
MARGIN = 3

#: Latin-1 letters, lower case; digits; white space (fixed values of the tokenizer's pattern within Latin-1).
LETTERS = rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
NUMBERS = rb"0-9\xb2\xb3\xb9\xbc-\xbe"
BLANKS = rb"\x09-\x0d\x20\x85\xa0"
PIECES = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[" + LETTERS + rb"]+|[" + NUMBERS + rb"]|[^" + LETTERS + NUMBERS + BLANKS + rb"]+")
#: A full stop or comma before white space that belongs to a longer run of punctuation.
MIXED_STOPS = re.compile(rb"[^" + LETTERS + NUMBERS + rb"][.,][ \n]")
LOWER = bytes(b + 32 if 65 <= b <= 90 or 0xC0 <= b <= 0xDE and b != 0xD7 else b for b in range(256))
ASCII_SPACE = b" \t\n\r\x0b\x0c"

#: One pseudo-random 32-bit number a byte value, for the rolling hash.
GEAR = np.random.default_rng(1).integers(0, 1 << 32, 256, dtype=np.uint32)


class Cache:
    """A dict bounded in bytes that keeps what is used: entries move from the old half to the young one when read."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.young, self.old, self.size = {}, {}, 0

    def turn(self) -> None:
        """Between texts: a full young half becomes the old one."""
        if self.size > self.most:
            self.young, self.old, self.size = {}, self.young, 0

    def add(self, keys: list, values: list) -> None:
        self.young.update(zip(keys, values, strict=True))
        self.size += sum(map(len, keys)) + sum(map(len, values)) + ENTRY_BYTES * len(keys)

    def missing(self, keys) -> list:
        """The keys that are in neither half; those found in the old half move to the young one."""
        out, found = [], []
        for k in set(keys).difference(self.young):
            (out if k not in self.old else found).append(k)
        self.add(found, [self.old.pop(k) for k in found])
        return out


class Chunk:
    """An encoded chunk: what is before its first white space, the ids of its words (None: no white space), what follows
    the last; and its first and last words, which the encoding of a join has to agree with."""

    __slots__ = ("first", "head", "ids", "last", "tail")

    def __init__(self, head: bytes, words: list[bytes] | None, tail: bytes, ids: bytes):
        self.head, self.ids, self.tail = head, None if words is None else ids, tail
        self.first, self.last = (words or [])[:MARGIN], (words or [])[-MARGIN:]

    def __len__(self) -> int:
        return len(self.head) + len(self.tail) + len(self.ids or b"") + 3 * ENTRY_BYTES


class Vocabulary:
    """Tokens by id, without the tokenizer: all that decoding takes."""

    def __init__(self, path: str):
        with open(path) as f:
            told = json.load(f)
        added = told.get("added_tokens", [])
        of = {i: t for t, i in told["model"]["vocab"].items()} | {t["id"]: t["content"] for t in added}
        self.special = [t["content"] for t in added]
        self.names = [of.get(i, "").encode() for i in range(max(of) + 1)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The library joins a decoder-less vocabulary's tokens by single spaces."""
        names = self.names
        return b" ".join([names[i] for i in ids.tolist()])


class Encoder:
    """The library's encoding of whole texts, as packed little-endian uint32 ids, word by word from a cache. Texts within
    Latin-1 have their pre-tokens cut here and encoded by the library in bulk; other texts go to it word by word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.encode() for t in vocabulary(path).special]
        self.ends = np.array([n.endswith(b"</w>") for n in vocabulary(path).names])
        self.words, self.others, self.chunks = Cache(CACHED_WORDS), Cache(CACHED_WORDS // 4), Cache(CACHED_CHUNKS)

    def turn(self) -> None:
        for cache in (self.words, self.others, self.chunks):
            cache.turn()

    def forget(self) -> None:
        """Empty the caches, so that an idle Python worker holds little memory."""
        for cache in (self.words, self.others, self.chunks):
            cache.clear()

    def direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, text: bytes) -> bytes | None:
        """The text in lower-case Latin-1, a full stop or comma that ends a word set apart (it is a pre-token of its own
        there); None for a text that has other characters or spells a special token."""
        try:
            t = text if text.isascii() else text.decode().encode("latin-1")
        except UnicodeError:
            return None
        if any(s in text for s in self.special):
            return None
        t = t.translate(LOWER)
        if not MIXED_STOPS.search(t):
            for stop in (b".", b","):
                for space in (b" ", b"\n"):
                    t = t.replace(stop + space, b" " + stop + space)
        return t

    def _fill(self, words) -> dict:
        """Make sure of lower-case Latin-1 words; gives the dict that has them. Their pre-tokens are encoded many at a
        time; each one's last token, and no other, ends a word."""
        cache = self.words
        compound = []
        single = set()
        for w in cache.missing(words):
            pieces = PIECES.findall(w)
            if len(pieces) == 1 and pieces[0] == w:
                single.add(w)
            else:
                compound.append((w, pieces))
        parts = {x for _, p in compound for x in p if x not in single}
        single.update(cache.missing(parts) if parts else ())
        single = list(single)
        for at in range(0, len(single), BULK):
            part = single[at : at + BULK]
            ids = self.direct([b" ".join(part).decode("latin-1")])[0]
            cut = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cut) == len(part):
                packed, cut = ids.tobytes(), cut.tolist()
                found = [packed[i:j] for i, j in zip([0, *cut], cut, strict=False)]
            else:
                found = [x.tobytes() for x in self.direct([p.decode("latin-1") for p in part])]
            cache.add(part, found)
        of = cache.young
        cache.add([w for w, _ in compound], [b"".join([of[x] for x in p]) for _, p in compound])
        return of

    def by_words(self, texts: list[bytes]) -> list[bytes]:
        ready = [self.plain(t) for t in texts]
        words = [None if t is None else t.split() for t in ready]
        of = self._fill(itertools.chain.from_iterable(w for w in words if w))
        out = [None if x is None else b"".join([of[w] for w in x]) for x in words]
        for i in (i for i, x in enumerate(out) if x is None):
            fragments = texts[i].split()
            missing = self.others.missing(fragments)
            for at in range(0, len(missing), BULK):
                part = missing[at : at + BULK]
                self.others.add(part, [x.tobytes() for x in self.direct([w.decode() for w in part])])
            out[i] = b"".join([self.others.young[w] for w in fragments])
        return out

    def short(self, texts: list[bytes]) -> list[bytes]:
        """by_words() for texts that mostly are single words met before."""
        out = [self.words.young.get(t.translate(LOWER)) if t.isascii() and b"<" not in t else None for t in texts]
        open_ = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(open_, self.by_words([texts[i] for i in open_]), strict=True):
            out[i] = ids
        return out

    def by_chunks(self, texts: list[bytes]) -> list[bytes]:
        cut = [chunked(t) for t in texts]
        fresh = self.chunks.missing(itertools.chain.from_iterable(cut))
        split = [chunk_words(c) for c in fresh]
        inner = self.by_words([b" ".join(words or ()) for _, words, _ in split])
        self.chunks.add(fresh, [Chunk(*x, ids) for x, ids in zip(split, inner, strict=True)])
        known = self.chunks.young
        plans = []
        for chunks in cut:
            plan, pending, last = [], b"", []
            for c in map(known.__getitem__, chunks):
                pending += c.head
                if c.ids is not None:  # white space was met: the join before this chunk is complete
                    plan += [(last, pending, c.first), c.ids]
                    pending, last = c.tail, c.last
            plans.append([*plan, (last, pending, [])])
        repaired = iter(self.repaired([join for plan in plans for join in plan[::2]]))
        out = []
        for text, plan in zip(texts, plans, strict=True):
            joins = [next(repaired) for _ in plan[::2]]
            if None in joins:
                out.append(self.direct([text.decode()])[0].tobytes())
            else:
                out.append(b"".join([x for pair in zip(joins, [*plan[1::2], b""], strict=True) for x in pair]))
        return out

    def repaired(self, joins: list[tuple[list[bytes], bytes, list[bytes]]]) -> list[bytes | None]:
        """The ids of each join, given the words before and after it; None where they never came to agree."""
        out: list[bytes | None] = [None if joint else b"" for _, joint, _ in joins]
        open_ = [i for i, (_, joint, _) in enumerate(joins) if joint]
        for width in range(1, MARGIN + 1):
            before, after = ([b" ".join(w) for w in side] for side in ([joins[i][0][-width:] for i in open_], [joins[i][2][:width] for i in open_]))
            spans = [b" ".join([x for x in (a, joins[i][1], z) if x]) for i, a, z in zip(open_, before, after, strict=True)]
            distinct = list(dict.fromkeys(spans))
            of = dict(zip(distinct, (x.tobytes() for x in self.direct([s.decode() for s in distinct])), strict=True))
            for i, span, a, z in zip(open_, spans, self.short(before), self.short(after), strict=True):
                ids = of[span]
                if len(ids) >= len(a) + len(z) and ids.startswith(a) and ids.endswith(z):
                    out[i] = ids[len(a) : len(ids) - len(z)]
            if not (open_ := [i for i in open_ if out[i] is None]):
                break
        return out


def chunked(text: bytes, average: int = CHUNK_BYTES) -> list[bytes]:
    """Cut after every byte whose rolling hash of the 32 bytes up to it has its top bits clear, but never inside a
    UTF-8 character."""
    b = np.frombuffer(text, np.uint8)
    if len(b) < 2:
        return [text] if text else []
    h = GEAR[b]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            more = h[:-step] << np.uint32(step)
            h[step:] += more
    cuts = np.flatnonzero(h < np.uint32((1 << 32) // average)) + 1
    cuts = cuts[cuts < len(b)]
    cuts = np.concatenate([[0], cuts[(b[cuts] & 0xC0) != 0x80], [len(b)]]).tolist()
    return [text[i:j] for i, j in itertools.pairwise(cuts)]


def chunk_words(chunk: bytes) -> tuple[bytes, list[bytes] | None, bytes]:
    """What is before the first white space, the words up to the last, and what follows it; a chunk without white
    space is all head and has None for words."""
    words = chunk.split()
    first, last = chunk[0] in ASCII_SPACE, chunk[-1] in ASCII_SPACE
    if len(words) < 2 and not first and not last:
        return chunk, None, b""
    head = b"" if first else words.pop(0)
    tail = b"" if last or not words else words.pop()
    return head, words, tail


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker and vocabulary, with what it has cached."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def coded(docs: DataFrame, columns: tuple[str, ...], tokenizer_path: str | None = None, reuse_chunks: bool = True, end_id: int | None = None) -> DataFrame:
    """doc_id, n_tokens and the columns named, of every row's whole text; null is empty and has no ids:

    ids             packed little-endian uint32
    text            the ids decoded again
    ids_sha256      of the decimal ids joined by single spaces, lower-case hex
    decoded_sha256  of the decoded text in UTF-8

    end_id, if given, is appended to each. tokenizer_path is a file that every executor has, of a tokenizer that drops
    white space, marks word ends and has no decoder. Rows that repeat a doc_id each give a row, also those without one;
    extra columns are ignored.
    """
    path = tokenizer_path or default_path()
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def of(piece):
        texts = [(t or "").encode("utf-8", "replace") for t in piece.column("text").to_pylist()]
        e = encoder(path)
        e.turn()
        packed = [x + tail for x in (e.by_chunks(texts) if reuse_chunks else e.by_words(texts))]
        del texts
        out = {"doc_id": piece.column("doc_id"), "n_tokens": [len(x) // 4 for x in packed]}
        if "ids" in columns:
            out["ids"] = packed
        if "ids_sha256" in columns:
            out["ids_sha256"] = [hashlib.sha256(b" ".join([b"%d" % i for i in np.frombuffer(x, "<u4").tolist()])).hexdigest() for x in packed]
        if {"text", "decoded_sha256"} & set(columns):
            said = [vocabulary(path).decode(np.frombuffer(x, "<u4")) for x in packed]
            if "text" in columns:
                out["text"] = [x.decode() for x in said]
            if "decoded_sha256" in columns:
                out["decoded_sha256"] = [hashlib.sha256(x).hexdigest() for x in said]
        return out

    kinds = {"ids": "binary"}
    schema = ", ".join(["doc_id long", "n_tokens long", *[f"{c} {kinds.get(c, 'string')}" for c in columns]])
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), of, schema, chars=SLICE_BYTES, finish=lambda: encoder(path).forget())


def encode(docs: DataFrame, tokenizer_path: str | None = None, **how) -> DataFrame:
    """doc_id, n_tokens and ids of every row's whole text, as in coded()."""
    return coded(docs, ("ids",), tokenizer_path, **how)


def decode(encoded: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of packed ids."""
    path = tokenizer_path or default_path()

    def of(piece):
        e = vocabulary(path)
        return {n: piece.column(n) for n in ("doc_id", "n_tokens", "ids")} | {"text": [e.decode(np.frombuffer(x, "<u4")).decode() for x in piece.column("ids").to_pylist()]}

    return map_texts(encoded.select("doc_id", "n_tokens", "ids"), of, "doc_id long, n_tokens long, ids binary, text string", column="ids")


def digest(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids of every row's whole text and of what they decode to."""
    return coded(docs, ("ids_sha256", "decoded_sha256"), tokenizer_path)
