"""Byte-level BPE encoding and decoding.

Encoding splits a text with the usual byte-level pattern and merges the bytes of
each piece: the symbols form a doubly linked list, a priority queue holds the
merge ranks of neighbouring pairs, and entries whose symbols have changed since
are skipped when they come up.  Decoding concatenates vocabulary strings.

Results in odd cases: a null or empty text has no tokens, an empty decoded text
and the digests of the empty string; special tokens' strings inside a text
become their one id; ids repeat as rows repeat; texts of any length are handled
piece by piece; an empty table gives an empty result; other columns, whatever
their names, are passed over.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, documents, kept

# The split pattern of byte-level BPE vocabularies.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
# Letters, numbers and white space below U+0250, for texts that have nothing above.
LETTERS, NUMBERS, BLANKS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN = rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
#: Pieces remembered in each of two halves, their length, and pieces handled at once.
REMEMBERED, SHORT, RUN = 300_000, 48, 1 << 16
#: Characters of a text that are cut into pieces at once at most; longer ones are cut run by run, which gives the same pieces.
LONG = 1 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Splitter:
    """Cuts texts into pieces; the standard library is faster where its character classes will do."""

    def __init__(self):
        self.every, self.latin, self.other = regex.compile(PATTERN), re.compile(LATIN), re.compile(r"[^\x00-\u024f]")

    def pattern(self, text: str):
        return self.every if self.other.search(text) else self.latin


class Pieces(dict):
    """What was made of short pieces; the half that was not used of late is forgotten."""

    def __init__(self, make):
        self.make, self.before = make, {}

    def __missing__(self, piece: str):
        found = self.before.get(piece)
        if found is None:
            found = self.make(piece)
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[piece] = found
        return found


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = {c: b for b, c in enumerate(byte_letters())}
        vocab, self.ranks = spec["model"]["vocab"], {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.bytes_ids = [vocab[c] for c in byte_letters()]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {str(i): bytes(letters[c] for c in s) for s, i in vocab.items()}
        self.strings |= {str(i): s.encode() for s, i in self.special.items()}
        self.strings[""] = b""
        self.split = Splitter()
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = Pieces(lambda piece: ",".join(map(str, self.merge(piece.encode()))))

    def merge(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        ids = [self.bytes_ids[b] for b in data]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(*self.ranks[p], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.ranks]
        heapq.heapify(queue)
        queue = [(r, i, new, a, b) for r, new, i, a, b in queue]
        heapq.heapify(queue)
        while queue:
            _, i, new, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale: one of the two has been merged meanwhile
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (new, ids[k]) in self.ranks:
                    r, made = self.ranks[new, ids[k]]
                    heapq.heappush(queue, (r, i, made, new, ids[k]))
            h = before[i]
            if h >= 0 and (ids[h], new) in self.ranks:
                r, made = self.ranks[ids[h], new]
                heapq.heappush(queue, (r, h, made, ids[h], new))
        return [x for x in ids if x >= 0]

    def _plain(self, text: str) -> Iterator[list[str]]:
        if len(text) <= LONG:
            yield self.split.pattern(text).findall(text)
            return
        found = (m.group() for m in self.split.pattern(text).finditer(text))
        while run := list(islice(found, RUN)):
            yield run

    def encoded(self, text: str) -> Iterator[str]:
        """Ids of runs of the text, each as decimals joined by commas."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield from self._runs(text[at : m.start()])
            yield str(self.special[m.group()])
            at = m.end()
        yield from self._runs(text[at:] if at else text)

    def _runs(self, text: str) -> Iterator[str]:
        for pieces in self._plain(text):
            if pieces:
                yield ",".join(map(self.pieces.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        return [int(x) for run in self.encoded(text) for x in run.split(",")]

    def decode_run(self, run: str) -> bytes:
        return b"".join(map(self.strings.__getitem__, run.split(",")))

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.strings[str(i)] for i in ids).decode("utf-8", "replace")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Encode and decode each text: id, n_tokens, ids_sha256, decoded_sha256.

    With texts, also the ids and the decoded text themselves.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts

    def make():
        codec = kept(f"codec {vocabulary}", lambda: Codec(vocabulary))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, digests, decoded, ids, back = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                n, a, data, own = 0, hashlib.sha256(), [], []
                for run in codec.encoded(text or ""):
                    a.update((("," if n else "") + run).encode())
                    n += run.count(",") + 1
                    data.append(codec.decode_run(run))
                    if texts:
                        own += map(int, run.split(","))
                out = b"".join(data).decode("utf-8", "replace")
                counts.append(n)
                digests.append(a.hexdigest())
                decoded.append(hashlib.sha256(out.encode()).hexdigest())
                if texts:
                    ids.append(own)
                    back.append(out)
            made = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if texts:
                made += [pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())]
                names += ["ids", "decoded"]
            return pa.RecordBatch.from_arrays(made, names)

        return step

    return arrow_map(docs.select(id_col, F.col(text_col)), schema, make)


def op5_bpe(spark, sf_dir):
    return bpe_round_trip(documents(spark, sf_dir), default_vocabulary())
