"""Byte-pair encoding as a streaming transducer with bounded lookahead, and incremental decoding.

The encoding of a prefix extends the encoding of a shorter prefix by one token. So the transducer keeps, for
each byte position, the last token of the prefix that ends there: the one token t that ends there and is
compatible with the last token of the prefix before it (the pair t', t is its own encoding). A later token can
only begin at a position from which the bytes read so far are a proper prefix of some token; the length of the
longest token less one is the merge list's sufficient lookahead. The tokens before the point where the chains of
all such positions meet can no longer change, and are emitted; the rest is the whole memory.

A text is a stream that is fed in parts. It is cut to pieces by the tokenizer's pattern as soon as a cut is certain,
which bounds nothing but keeps most runs short. The pieces of many streams run through the transducer in lockstep,
one byte of each at a time, in numpy; what a piece became is remembered, up to a bound. Longer ones (over LOCKSTEP
bytes) go through it one by one, and one of thousands of characters while it arrives.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.text import U64, Poly, mix, tidied

#: The split pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ranges in which regex and the tokenizers library agree on letters, numbers and spaces; other texts are cut by the library.
AGREED = re.compile("[^\x00-ԯऀ-௿฀-࿿Ḁ-⁯₠-⯿　-鿿가-힣＀-￯\U0001f300-\U0001faff]")
#: A space after white space: then a text is not cut at its spaces.
_NO_CUT = re.compile(r"\s ")
#: Signs that often end a word.
_SIGNS = frozenset(".,;:!?|")
LOCKSTEP = 32
#: Words remembered by a worker, and half as many pieces; about 250 MB.
REMEMBERED = 1_000_000
_NONE = np.int64(1) << 40


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in vocabularies of this kind: themselves where visible, else U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Merges:
    """A vocabulary with its merge list."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("a byte-level BPE tokenizer without normalizer and prefix space is needed")
        added = spec["added_tokens"]
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in added):
            raise ValueError("added tokens that strip or match words are not supported")
        self.path = path
        self.added = {x["content"]: x["id"] for x in added}
        self.added_pattern = re.compile("|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))) if added else None
        alphabet = byte_alphabet()
        vocab = model["vocab"]
        self.bytes = [b""] * (max(*vocab.values(), *self.added.values(), 0) + 1)
        for t, i in vocab.items():
            self.bytes[i] = t.encode() if t in self.added else bytes(alphabet[c] for c in t)
        for t, i in self.added.items():
            self.bytes[i] = t.encode()
        n = len(self.bytes)
        self.rank, self.left, self.right = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        a, b = (np.array([vocab[m[k]] for m in merges]) for k in (0, 1))
        made = np.array([vocab[x + y] for x, y in merges])
        self.rank[made], self.left[made], self.right[made] = np.arange(len(merges)), a, b
        key = a << 32 | b
        order = np.argsort(key)
        self.pair_key, self.pair_rank = key[order], order
        self.by_bytes = {self.bytes[i]: i for t, i in vocab.items() if t not in self.added}
        self.lookahead = max(map(len, self.by_bytes)) - 1
        self.prefixes = {t[:k] for t in self.by_bytes for k in range(1, len(t))}
        self.poly = Poly(97)
        ids = np.array(list(self.by_bytes.values()))
        flat = np.frombuffer(b"".join(self.by_bytes), np.uint8)
        ends = np.cumsum([len(t) for t in self.by_bytes])
        h = self.poly.slices(self.poly.prefix(self.poly.table[flat]), ends - np.array([len(t) for t in self.by_bytes]), ends)
        order = np.argsort(h)
        self.hash, self.hash_id = h[order], ids[order]
        self.sizes = np.array([len(t) for t in self.bytes])
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.at = np.append(0, np.cumsum(self.sizes))
        self.joined = functools.lru_cache(1 << 16)(lambda a, b: bool(self.compatible(np.array([a]), np.array([b]))[0]))

    def cross_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], _NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the encoding of the bytes of a and b is just these two tokens.

        The two are taken apart in the reverse order of their merges, and at no time may the pair at the seam
        have been due: before the merge that was undone last, or with it, if the seam's pair lies to its left.
        """
        good = np.ones(len(a), bool)
        where, limit = np.arange(len(a)), np.full(len(a), _NONE)
        while len(where):
            clash = self.cross_rank(a, b) < limit
            good[where[clash]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~clash & ((ra >= 0) | (rb >= 0))
            where, a, b, ra, rb = where[on], a[on], b[on], ra[on], rb[on]
            undo = ra > rb
            limit = np.where(undo, ra, rb + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return good

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each piece; short pieces in lockstep, long ones streamed."""
        out: list[bytes] = [b""] * len(pieces)
        short = [k for k, p in enumerate(pieces) if 0 < len(p) <= LOCKSTEP]
        for k, p in enumerate(pieces):
            if len(p) > LOCKSTEP:
                run = PieceTransducer(self)
                out[k] = np.array([*run.feed(p), *run.finish()], "<u4").tobytes()
        short.sort(key=lambda k: -len(pieces[k]))
        for at in range(0, len(short), 1 << 14):
            self._lockstep(pieces, short[at : at + (1 << 14)], out)
        return out

    def _lockstep(self, pieces: list[bytes], some: list[int], out: list[bytes]) -> None:
        """Pieces ordered by falling length: those that still have a byte at a position are the first ones."""
        n = len(some)
        length = np.array([len(pieces[k]) for k in some])
        data = np.zeros((n, length[0]), np.uint8)
        data[np.arange(length[0]) < length[:, None]] = np.frombuffer(b"".join(pieces[k] for k in some), np.uint8)
        self.poly.grow(LOCKSTEP + 1)
        prefix = np.zeros((length[0] + 1, n), U64)
        np.cumsum(self.poly.table[data.T] * self.poly.powers[: length[0], None], axis=0, out=prefix[1:])
        last = np.full((length[0] + 1, n), -1)
        for end in range(1, length[0] + 1):
            todo = np.arange(np.searchsorted(-length, -end, "right"))
            for size in range(min(end, self.lookahead + 1), 0, -1):
                h = mix((prefix[end, todo] - prefix[end - size, todo]) * self.poly.inverses[end - size])
                at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
                token = self.hash_id[at]
                hit = np.flatnonzero((self.hash[at] == h) & (self.sizes[token] == size))
                token = token[hit]
                if end > size and len(hit):
                    fits = self.compatible(last[end - size, todo[hit]], token)
                    hit, token = hit[fits], token[fits]
                last[end, todo[hit]] = token
                todo = np.delete(todo, hit)
                if not len(todo):
                    break
        for k in range(n):
            ids, at = [], int(length[k])
            row = last[:, k]
            while at:
                ids.append(int(row[at]))
                at -= len(self.bytes[ids[-1]])
            out[some[k]] = np.array(ids[::-1], "<u4").tobytes()


class PieceTransducer:
    """The transducer for one piece of any length; holds the bytes and tokens that are not yet certain."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.tail = b""  # bytes after the last certain boundary
        self.last: list[int] = [-1]  # last token of the prefix that ends at each boundary of tail
        self.live: list[int] = [0]  # positions in tail from which a token may still grow

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        m = self.m
        for byte in data:
            self.tail += bytes((byte,))
            end = len(self.tail)
            token = -1
            for start in self.live:
                t = m.by_bytes.get(self.tail[start:end])
                if t is not None and (start == 0 or m.joined(self.last[start], t)):
                    token = t
                    break
            self.last.append(token)
            self.live = [p for p in self.live if self.tail[p:end] in m.prefixes] + [end]
            if end > m.lookahead or len(self.live) == 1:
                out += self._settle()
        return out

    def _settle(self) -> list[int]:
        """Emits the tokens before the last boundary that the chains of all live positions share."""
        chains = [self._chain(p) for p in self.live]
        cut = max(set.intersection(*map(set, chains)))
        if not cut:
            return []
        out = self._tokens(cut)
        self.tail, self.last, self.live = self.tail[cut:], [-1, *self.last[cut + 1 :]], [p - cut for p in self.live]
        return out

    def _chain(self, at: int) -> list[int]:
        out = [at]
        while at:
            at -= len(self.m.bytes[self.last[at]])
            out.append(at)
        return out

    def _tokens(self, at: int) -> list[int]:
        out = []
        while at:
            out.append(self.last[at])
            at -= len(self.m.bytes[out[-1]])
        return out[::-1]

    def finish(self) -> list[int]:
        out = self._tokens(len(self.tail))
        self.__init__(self.m)
        return out


@functools.lru_cache(4)
def load(path: str) -> Merges:
    return Merges(path)


class Memo(dict):
    """Remembers what ``one`` makes of a key. ``age`` makes all keys old ones if there are too many; old keys are
    forgotten with the next ageing, unless they are met again."""

    def __init__(self, one: Callable[[str], bytes] | None):
        super().__init__()
        self.one = one
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        self[key] = value = self.one(key) if value is None else value
        return value

    def age(self, most: int) -> None:
        if len(self) > most:
            self.old = dict(self)
            self.clear()

    def new(self, keys: set[str]) -> list[str]:
        """Those of some keys that are not known; old ones become young."""
        keys.difference_update(self)
        back = keys & self.old.keys() if self.old else ()
        for k in back:
            self[k] = self.old[k]
        return list(keys.difference(back))


class Encoder:
    """Texts to ids.

    Texts are cut by the pattern, and the new pieces of many texts go through the transducer together. With ``one``,
    which encodes a piece when it is met, words are remembered as well, at one lookup a word: a space between two
    characters that are no white space always begins a piece, so a text that has only such spaces is cut there.
    """

    def __init__(self, merges: Merges, one: Callable[[str], bytes] | None = None, remembered: int = REMEMBERED):
        self.m, self.remembered, self.one = merges, remembered, one
        self.pattern = regex.compile(PATTERN)
        self.memo = Memo(one)
        self.words = Memo(self._word)  # by the word without the space before it
        self.cut_by_library = None

    def _word(self, w: str) -> bytes:
        """A word of letters is one piece with the space before it; one that a sign ends is two."""
        if w.isascii() or not AGREED.search(w):
            if w.isalpha():
                return self.one(" " + w)
            if w[-1:] in _SIGNS and w[:-1].isalpha():
                return self.words[w[:-1]] + self.memo[w[-1]]
        return b"".join(map(self.memo.__getitem__, self._cut(" " + w)))

    def _cut(self, text: str) -> list[str]:
        if text.isascii() or not AGREED.search(text):
            return self.pattern.findall(text)
        if self.cut_by_library is None:
            from tokenizers import pre_tokenizers

            self.cut_by_library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in self.cut_by_library.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str]:
        """Pieces in order; an added token is a piece of its own."""
        m = self.m
        if m.added_pattern is None or not m.added_pattern.search(text):
            return self._cut(text)
        out, at = [], 0
        for hit in m.added_pattern.finditer(text):
            out += [*self._cut(text[at : hit.start()]), hit.group()]
            at = hit.end()
        return out + self._cut(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if self.one is None:
            return self.encode_pieces([self.pieces(t) for t in texts])
        plain = [not (_NO_CUT.search(t) or t[:1] == " " or t[-1:] == " " or (self.m.added_pattern and self.m.added_pattern.search(t))) for t in texts]
        slow = iter(self.encode_pieces([self.pieces(t) for t, p in zip(texts, plain, strict=True) if not p]))
        self.words.age(self.remembered // 2)
        self.words[""] = b""
        word, piece = self.words.__getitem__, self.memo.__getitem__
        out = []
        for t, p in zip(texts, plain, strict=True):
            if not p:
                out.append(next(slow))
                continue
            w = t.split(" ")  # one text at a time, so that its words stay in the processor's cache
            head, w[0] = b"".join(map(piece, self.pieces(w[0]))), ""
            out.append(head + b"".join(map(word, w)))
        return out

    def encode_pieces(self, cut: list[list[str]]) -> list[bytes]:
        self.memo.age(self.remembered // (2 if self.one is None else 4))
        self.memo.update((t, np.array([i], "<u4").tobytes()) for t, i in self.m.added.items())
        if self.one is None and cut:
            new = self.memo.new(set().union(*cut))
            self.memo.update(zip(new, self.m.encode_many([p.encode() for p in new]), strict=True))
        get = self.memo.__getitem__
        return [b"".join(map(get, c)) for c in cut]


class Stream:
    """A text in parts of any size. What is certain comes out as pieces, and as ids of a piece too long to be held;
    memory doesn't grow with the text."""

    HOLD = 3  # characters that a split may still depend on
    LONG = 4096

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.text = ""
        self.run: PieceTransducer | None = None
        self.kind = None
        self.keep = max([self.HOLD, *map(len, encoder.m.added)])  # a part of an added token may stand at the end

    def _same(self, c: str) -> bool:
        return self.kind.fullmatch(c) is not None

    def feed(self, part: str) -> list[str | list[int]]:
        self.text += part
        out: list[str | list[int]] = [self._continue()] if self.run is not None else []
        if self.run is None and len(self.text) > self.LONG:
            pieces, n, at = self.encoder.pieces(self.text), 0, 0
            while n < len(pieces) and at + len(pieces[n]) <= len(self.text) - self.keep:
                at += len(pieces[n])
                n += 1
            out += pieces[:n]
            self.text = self.text[at:]
            if n < len(pieces) and len(pieces[n]) > self.LONG // 2 and pieces[n] not in self.encoder.m.added:
                self.kind = next(regex.compile(k) for k in (r"\p{L}", r"\p{N}", r"\s", r"[^\s\p{L}\p{N}]") if regex.fullmatch(k, self.text[1]))
                self.run = PieceTransducer(self.encoder.m)
                out.append(self.run.feed(self.text[:2].encode()))
                self.text = self.text[2:]
                out.append(self._continue())
        return out

    def _continue(self) -> list[int]:
        """Feeds what surely belongs to the long piece; ends it where another kind of character comes."""
        n = next((k for k, c in enumerate(self.text) if not self._same(c)), len(self.text))
        if n == len(self.text):
            n = max(0, n - self.keep)
            out, self.text = self.run.feed(self.text[:n].encode()), self.text[n:]
            return out
        n -= self.kind.pattern == r"\s"  # the last space goes with what follows
        out = self.run.feed(self.text[:n].encode()) + self.run.finish()
        self.text, self.run = self.text[n:], None
        return out

    def finish(self) -> list[str | list[int]]:
        out: list[str | list[int]] = []
        if self.run is not None:
            n = next((k for k, c in enumerate(self.text) if not self._same(c)), len(self.text))
            n -= n < len(self.text) and self.kind.pattern == r"\s"
            out.append(self.run.feed(self.text[:n].encode()) + self.run.finish())
            self.text, self.run = self.text[n:], None
        out += self.encoder.pieces(self.text)
        self.text = ""
        return out


def ids_of(encoder: Encoder, items: list[list[str | list[int]]]) -> list[bytes]:
    """Little-endian 32-bit ids of what came out of several streams; the new pieces of all go through the transducer together."""
    made = iter(encoder.encode_pieces([[x for x in one if isinstance(x, str)] for one in items]))
    out = []
    for one in items:
        raw = next(made)
        if any(not isinstance(x, str) for x in one):
            get = encoder.memo.__getitem__
            raw = b"".join(get(x) if isinstance(x, str) else np.array(x, "<u4").tobytes() for x in one)
        out.append(raw)
    return out


class StreamEncoder:
    """The ids of one text that comes in parts."""

    def __init__(self, merges: Merges):
        self.stream = Stream(Encoder(merges))

    def _ids(self, items: list[str | list[int]]) -> list[int]:
        return np.frombuffer(ids_of(self.stream.encoder, [items])[0], "<u4").tolist()

    def feed(self, part: str) -> list[int]:
        return self._ids(self.stream.feed(part))

    def finish(self) -> list[int]:
        return self._ids(self.stream.finish())


class Decoder:
    """Ids to text in parts. The state between parts is an unfinished character's bytes; malformed bytes become U+FFFD."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        some = ids.astype(np.int64)
        size = self.m.sizes[some]
        end = np.cumsum(size)
        raw = self.m.flat[np.repeat(self.m.at[some] - (end - size), size) + np.arange(end[-1])]
        return self.machine.decode(raw.tobytes())

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def decode(merges: Merges, ids: np.ndarray, at_once: int = 1 << 16) -> Iterator[str]:
    """The text of ``ids`` in parts."""
    machine = Decoder(merges)
    for k in range(0, len(ids), at_once):
        yield machine.feed(ids[k : k + at_once])
    yield machine.finish()


#: Characters of a text that its stream is fed at a time.
PART = 1 << 16


class RoundTrip:
    """One text's stream, and what its ids and their decoded text come to."""

    def __init__(self, encoder: Encoder, text: str, full: tuple[str, ...]):
        self.text, self.at, self.full = text, 0, full
        self.stream, self.decoder = Stream(encoder), Decoder(encoder.m)
        self.n, self.ids_digest, self.text_digest = 0, hashlib.sha256(), hashlib.sha256()
        self.ids: list[np.ndarray] = []
        self.parts: list[str] = []

    def items(self) -> list[str | list[int]]:
        """What comes out of the next part."""
        part = self.text[self.at : self.at + PART]
        self.at += PART
        out = self.stream.feed(part)
        return out + self.stream.finish() if self.at >= len(self.text) else out

    def take(self, raw: bytes) -> bool:
        """Adds ids; whether that were the last."""
        ids, last = np.frombuffer(raw, "<u4"), self.at >= len(self.text)
        self.n += len(ids)
        self.ids_digest.update(raw)
        part = self.decoder.feed(ids) + (self.decoder.finish() if last else "")
        self.text_digest.update(part.encode())
        if "ids" in self.full:
            self.ids.append(ids.astype(np.int32))
        if "decoded" in self.full:
            self.parts.append(part)
        return last


_ENCODERS: dict[str, Encoder] = {}


@tidied
def _encode(batches: Iterator[pa.RecordBatch], path: str, keep: list[str], full: tuple[str, ...], remembered: int = REMEMBERED) -> Iterator[pa.RecordBatch]:
    # beside other stages a worker has less memory, and then nothing is remembered from task to task
    encoder = Encoder(load(path), remembered=remembered) if remembered < REMEMBERED else _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(load(path)))
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            texts = [RoundTrip(encoder, t or "", full) for t in batch.column("text").to_pylist()]
            open_ = texts
            while open_:  # a part of each text at a time
                raws = ids_of(encoder, [t.items() for t in open_])
                open_ = [t for t, raw in zip(open_, raws, strict=True) if not t.take(raw)]
            out = [pa.array([t.n for t in texts], pa.int64()), pa.array([t.ids_digest.hexdigest() for t in texts]), pa.array([t.text_digest.hexdigest() for t in texts])]
            if "ids" in full:
                out.append(pa.array([np.concatenate(t.ids) for t in texts], pa.list_(pa.int32())))
            if "decoded" in full:
                out.append(pa.array(["".join(t.parts) for t in texts], pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *out], [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *full])


def encode_decode(documents: DataFrame, path: str, full: bool = True) -> DataFrame:
    """One row per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``full`` ids and decoded text.

    No shuffle: each Arrow batch is encoded where it is read. Texts run through their streams a part at a time, many
    texts side by side; a very long text takes more rounds, and memory beside the text itself stays the same. A null
    text is the empty text, with no ids. Added tokens in a text get their own id, as the tokenizers library does. A
    null doc_id stays null, repeated rows are encoded each, and other columns are not read.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    more = ("ids", "decoded") if full else ()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    return rows.mapInArrow(lambda it: _encode(it, path, ["doc_id"], more), schema)


def with_ids(documents: DataFrame, path: str, remembered: int = REMEMBERED // 3) -> DataFrame:
    """``documents`` as a struct of that name, with n_tokens, ids_sha256, decoded_sha256 and ids."""
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("document"), "text")
    kind = rows.schema["document"].dataType.simpleString()
    schema = f"document {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"
    return rows.mapInArrow(lambda it: _encode(it, path, ["document"], ("ids",), remembered), schema)
