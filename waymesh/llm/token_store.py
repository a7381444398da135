"""Token-id files with canonical length-limited Huffman coding.

Texts are encoded with a tokenizer file, an end id is appended to each
document, and ids are written in ascending doc_id order. The code lengths come
from the counts of all ids (package-merge, at most `limit` bits) and the codes
are canonical, so lengths alone describe them.

Format: two Parquet tables in one folder, written and read by Spark.
`codebook`: id, length. `blocks`: part and row (where the block stands), doc_ids
and lengths of its documents, marks (bits between checkpoints, one checkpoint
every `EVERY` ids) and payload. A block holds whole documents and decodes alone;
checkpoints let its segments decode side by side from one table.

A null or empty text is the end id alone. Documents of one doc_id stand next to
each other in the order of their texts' hashes; rows without a doc_id come first.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymesh.session import materialise, shared_dir

EVERY = 128
#: The pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def _byte_chars() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte: itself where printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TextEncoder:
    """Ids of texts by a tokenizer file of the tokenizers library.

    Where the file is a plain byte-level BPE, a text is cut into pre-tokens
    here, and the library's model encodes each different one once; a bounded
    memory keeps their ids. Characters are tried with the library's own pre-tokens
    before they are trusted. Texts with an added token or such a character, and
    files of other kinds, go through the library whole.
    """

    def __init__(self, file: str, most: int = 400_000, longest: int = 64):
        import regex
        import tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = tokenizers.Tokenizer.from_file(file)
        spec = json.loads(self.tok.to_str())
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.plain = model["type"] == "BPE" and not model.get("dropout") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.words = regex.compile(PATTERN).findall
        self.known: dict[str, bytes] = {}
        self.trusted: dict[str, bool] = {}
        self.most, self.longest = most, longest
        self.bytes = _byte_chars()

    def _trust(self, c: str) -> bool:
        """Whether the library cuts a text with this character as the pattern does."""
        s = f"a{c}1{c}{c} {c}.{c}\n{c}"
        return [s[i:j] for _, (i, j) in self.tok.pre_tokenizer.pre_tokenize_str(s)] == self.words(s)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.plain or any(t in text for t in self.added):
            return self._whole(text)
        for c in set(text).difference(self.trusted):
            self.trusted[c] = self._trust(c)
        if not text.isascii() and not all(map(self.trusted.__getitem__, set(text))):
            return self._whole(text)
        words = self.words(text)
        new = list(set(words).difference(self.known))
        if new:
            if len(self.known) + len(new) > self.most:
                self.known.clear()
                new = list(set(words))
            tokenize, table = self.tok.model.tokenize, self.bytes
            for w in new:
                self.known[w] = array("I", [t.id for t in tokenize(w.encode("utf-8", "surrogatepass").decode("latin-1").translate(table))]).tobytes()
        out = b"".join(map(self.known.__getitem__, words))
        for w in new:
            if len(w) > self.longest:
                del self.known[w]
        return out


_ENCODERS: dict[str, TextEncoder] = {}


def encode_texts(texts: list[str | None], file: str, end: int) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers, the end id last."""
    if file not in _ENCODERS:
        _ENCODERS[file] = TextEncoder(file)
    tail = np.array([end], "<u4").tobytes()
    return [_ENCODERS[file].encode(t or "") + tail for t in texts]


def token_ids(text: Column, file: str, end: int) -> Column:
    """Column of ids as little-endian 32-bit integers in one binary value."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(encode_texts(s.tolist(), file, end))

    return run(text)


def narrow(ids: bytes) -> bytes:
    """32-bit ids as 16-bit ones where all fit, with a byte that says so."""
    x = np.frombuffer(ids, "<u4")
    return b"\2" + x.astype("<u2").tobytes() if not len(x) or x.max() < 1 << 16 else b"\4" + ids


def widen(data: bytes) -> np.ndarray:
    """The ids that narrow() was given."""
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype(np.uint32)


def code_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for positive counts, by package-merge; more symbols than codes of that length raise the limit to what they need."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    limit = max(limit, (n - 1).bit_length() + 1 if n > 1 << limit else limit)
    order = np.argsort(counts, kind="stable")
    w = counts[order].astype(np.float64)
    level, kinds = w, []
    kind = np.ones(n, bool)
    for _ in range(limit - 1):
        kinds.append(kind)
        packs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.r_[w, packs]
        at = np.argsort(both, kind="stable")
        level, kind = both[at], at < n
    kinds.append(kind)
    lengths, need = np.zeros(n, np.int64), 2 * n - 2
    for kind in reversed(kinds):
        singles = int(kind[:need].sum())
        lengths[:singles] += 1
        need = 2 * (need - singles)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical codes of ids, from their lengths."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = np.asarray(ids, np.uint32)[order], np.asarray(lengths, np.int64)[order]
        self.width = int(self.lengths.max()) if len(ids) else 1
        spans = np.int64(1) << (self.width - self.lengths)
        first = np.cumsum(spans) - spans  # left-aligned codes
        size = int(self.ids.max()) + 1 if len(ids) else 0
        self.code, self.bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[self.ids], self.bits[self.ids] = (first >> (self.width - self.lengths)).astype(np.uint64), self.lengths
        self.symbol = np.zeros(1 << self.width, np.uint32)
        self.length = np.ones(1 << self.width, np.int64)
        used = int(spans.sum()) if len(ids) else 0
        self.symbol[:used], self.length[:used] = np.repeat(self.ids, spans), np.repeat(self.lengths, spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(payload, bits of every EVERY ids)."""
        bits = self.bits[ids]
        end = np.cumsum(bits)
        if not len(ids):
            return b"", np.zeros(0, np.uint32)
        at = end - bits
        word, room = at >> 6, 64 - (at & 63) - bits
        c = self.code[ids]
        head = np.where(room >= 0, c << np.maximum(room, 0).astype(np.uint64), c >> np.maximum(-room, 0).astype(np.uint64))
        out = np.zeros(int(end[-1] + 63 >> 6) + 1, np.uint64)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[first]] = np.bitwise_or.reduceat(head, first)
        over = np.flatnonzero(room < 0)  # at most one id crosses into a word
        out[word[over] + 1] |= c[over] << (64 + room[over]).astype(np.uint64)
        data = out.astype(">u8").tobytes()[: int(end[-1] + 7 >> 3)]
        stops = np.r_[end[EVERY - 1 :: EVERY], end[-1:]] if len(ids) % EVERY else end[EVERY - 1 :: EVERY]
        return data, np.diff(np.r_[0, stops]).astype(np.uint32)

    def decode(self, blocks: list[tuple[bytes, np.ndarray, int]]) -> list[np.ndarray]:
        """Ids of each (payload, marks, number of ids); all segments of all blocks step together."""
        begin, left, base = [], [], 0
        for data, marks, n in blocks:
            begin.append(base * 8 + np.r_[0, np.cumsum(np.asarray(marks, np.int64))[:-1]] if len(marks) else np.zeros(0, np.int64))
            left.append(np.minimum(EVERY, n - EVERY * np.arange(len(marks))))
            base += len(data)
        b = np.frombuffer(b"".join(d for d, _, _ in blocks) + b"\0" * 8, np.uint8).astype(np.uint32)
        pos, left = np.concatenate([np.zeros(0, np.int64), *begin]), np.concatenate([np.zeros(0, np.int64), *left]).astype(np.int64)
        pos = pos.astype(np.int64)
        if self.width > 25:  # a window of 32 bits starts within a byte
            raise ValueError("codes of more than 25 bits")
        words = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        out = np.zeros((len(pos), EVERY), np.uint32)
        shift = 32 - self.width
        for t in range(int(left.max()) if len(left) else 0):
            win = (words[pos >> 3] << (pos & 7).astype(np.uint32)) >> np.uint32(shift)
            out[:, t] = self.symbol[win]
            pos += np.where(t < left, self.length[win], 0)
        flat = out[np.arange(EVERY) < left[:, None]]
        return np.split(flat, np.cumsum([n for _, _, n in blocks])[:-1]) if blocks else []


def write_tokens(docs: DataFrame, path: str, file: str, end: int, block_ids: int = 32_768, limit: int = 16, parts: int | None = None) -> None:
    """Write docs(doc_id, text) as token-id files at path."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([narrow(x) for x in encode_texts(s.tolist(), file, end)])

    # texts are dealt out, not ids: to find its ranges Spark runs what comes before twice
    # one id, or none, on many rows: they go on by their text's hash and their own number, so no range holds them all
    keys = [F.asc_nulls_first("doc_id"), "hash", "number"]
    tagged = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("number"))
    ranged = tagged.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ranged = ranged.select("doc_id", packed("text").alias("ids"))
    # monotonically_increasing_id: the partition in its upper bits, the row within in its lower 33
    ids = materialise(ranged.withColumn("row", F.monotonically_increasing_id()), "ids")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for i in range(0, len(b), 500):
                c = np.bincount(np.concatenate([widen(x) for x in b["ids"].iloc[i : i + 500]])).astype(np.int64)
                total = np.r_[total, np.zeros(max(0, len(c) - len(total)), np.int64)]
                total[: len(c)] += c
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    # one row per id of the vocabulary
    counts = ids.select("ids").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()
    book = pd.DataFrame({"id": counts["id"].astype("int64"), "length": code_lengths(counts["n"].to_numpy(), limit)})
    spark.createDataFrame(book, "id long, length int").coalesce(1).write.parquet(f"{path}/codebook")
    code = spark.sparkContext.broadcast((book["id"].to_numpy(), book["length"].to_numpy()))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Code(*code.value)
        held: list[tuple] = []
        size = 0

        def block() -> tuple:
            data, marks = c.encode(np.concatenate([x for _, _, x in held]))
            return held[0][1] >> 33, held[0][1], [d for d, _, _ in held], [len(x) for _, _, x in held], marks.astype(np.int64), data

        cols = ["part", "row", "doc_ids", "lengths", "marks", "payload"]
        for b in batches:
            done = []
            for d, r, x in zip(b["doc_id"].tolist(), b["row"].tolist(), b["ids"], strict=True):
                if held and (size >= block_ids or r != held[-1][1] + 1):  # full, or another part begins
                    done.append(block())
                    held, size = [], 0
                held.append((d, r, widen(x)))
                size += len(held[-1][2])
            yield pd.DataFrame(done, columns=cols)
        if held:
            yield pd.DataFrame([block()], columns=cols)

    kind = docs.schema["doc_id"].dataType.simpleString()
    # an id travels as text: pandas would make floats of integers next to a null
    packed_ids = ids.select(F.col("doc_id").cast("string"), "row", "ids").mapInPandas(pack, "part long, row long, doc_ids array<string>, lengths array<int>, marks array<int>, payload binary")
    packed_ids.withColumn("doc_ids", F.col("doc_ids").cast(f"array<{kind}>")).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, digest: bool = True) -> DataFrame:
    """(part, row, nth, doc_id, n_tokens, and ids_crc32 or ids) of the files at path."""
    book = spark.read.parquet(f"{path}/codebook").toPandas()  # at most one row per id of the vocabulary
    code = spark.sparkContext.broadcast((book["id"].to_numpy(), book["length"].to_numpy()))
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    last = "ids_crc32 long" if digest else "ids binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Code(*code.value)
        for b in batches:
            for i in range(0, len(b), 16):
                rows = []
                s = b.iloc[i : i + 16]
                flat = c.decode([(p, m, int(n.sum())) for p, m, n in zip(s["payload"], s["marks"], s["lengths"], strict=True)])
                for part, row, ds, ns, x in zip(s["part"], s["row"], s["doc_ids"], s["lengths"], flat, strict=True):
                    raw, at = x.astype("<u4").tobytes(), np.r_[0, np.cumsum(ns)] * 4
                    for k, d in enumerate(ds):
                        one = raw[at[k] : at[k + 1]]
                        rows.append((part, row, k, d, int(ns[k]), zlib.crc32(one) if digest else one))
                yield pd.DataFrame(rows, columns=["part", "row", "nth", "doc_id", "n_tokens", last.split()[0]])

    named = blocks.select("part", "row", F.col("doc_ids").cast("array<string>"), "lengths", "marks", "payload")
    return named.mapInPandas(run, f"part long, row long, nth int, doc_id string, n_tokens long, {last}").withColumn("doc_id", F.col("doc_id").cast(kind))


def token_index(docs: DataFrame, file: str, end: int = 2, path: str | None = None) -> DataFrame:
    """Write docs as token-id files, read them back: doc_id, start, n_tokens and ids_crc32 of each document."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, file, end)
    got = materialise(read_tokens(spark, path), "read")
    sums = sorted((r["part"], r["n"]) for r in got.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # one row per partition
    base, total = {}, 0
    for part, n in sums:
        base[part], total = total, total + n
    before = F.element_at(F.create_map(*(F.lit(int(v)) for kv in base.items() for v in kv)), F.col("part")) if base else F.lit(0)
    w = Window.partitionBy("part").orderBy("row", "nth").rowsBetween(Window.unboundedPreceding, -1)
    return got.select("doc_id", (before.cast("long") + F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")
