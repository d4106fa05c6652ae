"""Byte-level BPE by a contiguous rank array.

A text is cut by the vocabulary's pattern into short words.  A word's bytes
are parts; one array holds what stands between part boundaries (as ids), one the
rank of joining across each boundary.  The least rank is looked for by a scan,
its boundary deleted, and the two ranks that touch the change are computed
anew, until no pair has a rank.  Words repeat, so results are kept in a table
of bounded size for each Python worker.  Words of over ``LONG`` bytes go
through a heap with the same order of merges, as scans would take time with
the square of the length.

Decoding joins the bytes of the ids and reads them as UTF-8, bad bytes
replaced.  The special token's string in a text is its id, as the library has
it by default.

Edge cases: null and empty texts have no tokens and decode to the empty text;
repeated rows and ties have equal results (of equal ranks the leftmost merges
first).  Nothing is cut: texts of any length are encoded whole.  A null doc_id
is kept; other columns, whatever their names, are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words in each half of a worker's table, about 350 bytes each; the older half goes when the younger is full.
CACHE = 160_000
LONG = 128
NO_RANK = 1 << 30
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def vocabulary_path() -> str:
    """Where the public vocabulary is installed; a parameter everywhere else."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, cache: int = 0):
        self.cache = cache or CACHE
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        raw = {t: bytes(back[c] for c in t) for t in spec["model"]["vocab"]}
        self.ids = {raw[t]: i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max(*self.ids.values(), *self.special.values(), 0) + 1)
        for t, i in self.ids.items():
            self.bytes_of[i] = t
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.byte_ids = [self.ids.get(bytes([b]), -1) for b in range(256)]
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self.pairs: dict[int, int] = {}  # ids of two parts, 20 bits each: the rank of joining them
        self.made: list[int] = []  # by rank: the id of the joined part
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[self.ids[raw[a]] << 20 | self.ids[raw[b]]] = rank
            self.made.append(self.ids[raw[a] + raw[b]])
        self.words = regex.compile(PATTERN)
        self.cuts = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, tuple[list[int], str]] = {}
        self.older: dict[str, tuple[list[int], str]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Parts of a short word: the ids between boundaries and the ranks across them, in two arrays scanned for the least rank."""
        get, made = self.pairs.get, self.made
        part = [self.byte_ids[b] for b in word]
        rank = [get(a << 20 | b, NO_RANK) for a, b in zip(part, part[1:], strict=False)]
        while rank:
            low = min(rank)
            if low == NO_RANK:
                break
            i = rank.index(low)
            new = part[i] = made[low]
            del part[i + 1], rank[i]
            if i < len(rank):
                rank[i] = get(new << 20 | part[i + 1], NO_RANK)
            if i:
                rank[i - 1] = get(part[i - 1] << 20 | new, NO_RANK)
        return part

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges in the same order, the least rank kept in a heap."""
        get, n = self.pairs.get, len(word)
        part = [self.byte_ids[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := get(part[i] << 20 | part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            low, i, a, b = heapq.heappop(heap)
            m = after[i] if part[i] == a else n
            if m >= n or part[m] != b:
                continue
            part[i], part[m] = self.made[low], -1
            after[i] = e = after[m]
            if e < n:
                before[e] = i
                if (r := get(part[i] << 20 | part[e])) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[e]))
            p = before[i]
            if p >= 0 and (r := get(part[p] << 20 | part[i])) is not None:
                heapq.heappush(heap, (r, p, part[p], part[i]))
        return [x for x in part if x >= 0]

    def word(self, w: str) -> tuple[list[int], str]:
        """Ids of a word, and those as decimals joined by commas; kept in the young half of the table."""
        if (found := self.older.get(w)) is None:
            raw = w.encode("utf-8")
            ids = self.merge(raw) if len(raw) <= LONG else self.merge_long(raw)
            found = ids, ",".join([self.decimal[i] for i in ids])
            if len(raw) > LONG:
                return found
        if len(self.known) >= self.cache:
            self.older, self.known = self.known, {}
        self.known[w] = found
        return found

    def pieces(self, text: str) -> list[tuple[list[int], str]]:
        out: list[tuple[list[int], str]] = []
        at = 0
        if self.cuts and any(s in text for s in self.special):
            for cut in self.cuts.finditer(text):
                out += self.plain(text[at : cut.start()])
                i = self.special[cut.group()]
                out.append(([i], str(i)))
                at = cut.end()
        return out + self.plain(text[at:] if at else text)

    def plain(self, text: str) -> list[tuple[list[int], str]]:
        """Of text without special tokens."""
        word = self.word
        words = self.words.findall(text)
        known = self.known
        if len(known) + len(words) < self.cache:
            get = known.get
            return [get(w) or word(w) for w in words]
        return [self.known.get(w) or word(w) for w in words]

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(ids for ids, _ in self.pieces(text or "")))

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=2)
def codec(path: str, cache: int = 0) -> Codec:
    """A worker keeps the codecs that it has used."""
    return Codec(path, cache)


def digest_batches(path: str, cache: int = 0):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or vocabulary_path(), cache)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n, ids_sha, text_sha = [], [], []
                for text in batch.column(1).to_pylist():
                    pieces = list(c.pieces(text or ""))
                    ids = list(chain.from_iterable([p[0] for p in pieces]))
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join([p[1] for p in pieces]).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(c.decode(ids).encode("utf-8")).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_batches(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or vocabulary_path())
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = [c.encode(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def decode_batches(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or vocabulary_path())
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


def encode(docs: DataFrame, path: str = "", text: str = "text") -> DataFrame:
    """doc_id and the ids of the whole text; ``path`` must be readable on executors, empty takes the installed file."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text)).mapInArrow(encode_batches(path), "doc_id bigint, ids array<int>")


def decode(tokens: DataFrame, path: str = "") -> DataFrame:
    """doc_id and the text of ``ids``."""
    return tokens.select("doc_id", "ids").mapInArrow(decode_batches(path), "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str = "", text: str = "text", cache: int = 0) -> DataFrame:
    """Token count and digests of the ids and of the text decoded from them; no shuffle.

    ``cache`` is the words in each half of a worker's table (0: ``CACHE``), for
    workers that hold other tables, too; results do not depend on it.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text)).mapInArrow(digest_batches(path, cache), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
