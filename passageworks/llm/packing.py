"""Packing along a space-filling curve.

Documents become token ids and a vector: signs hashed from the ids, summed in a few
dimensions and scaled by the length.  A Hilbert key over the quantised dimensions
orders them, so that neighbours along the curve are alike.  The documents are laid end
to end in that order and cut at every `limit` tokens; what is left at the end is cut
into powers of two, so that no sequence needs padding.

The order takes one range sort of (key, id, row, length) rows; the ids move once, to
meet their places.  A document's place is the sum of the lengths before it, taken within
the sorted partitions and over the partitions' totals, so no task sees more than its
partition, whatever the key's skew: equal keys are ordered, and split, by id.

Defined cases: a null text is empty and has only the end id; rows that repeat an id or a
whole row are documents of their own; without rows there is no piece.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passageworks.llm.batches import mixed, ragged, slices
from passageworks.llm.columns import picked, whole
from passageworks.session import ship_package, stored

LIMIT = 2048
END_ID = 1
DIMENSIONS, BITS = 4, 12
#: Text bytes whose distinct words a task looks up together, and of those that it works on at once.
LOOKUP_BYTES, WORK_BYTES = 2 << 20, 1 << 20
#: Parts of words whose ids a worker remembers (of other words half as many), and their length.
MEMORY_WORDS, REMEMBERED = 1 << 18, 64
#: Words that are written out at once.
WORK_WORDS = 1 << 16
#: Rows in a partition of the range sort.
SORT_ROWS = 1 << 20


class Encoder:
    """Ids of texts, word by word: for tokenizers that treat white space as a break.

    Such a tokenizer gives a text the ids of its words in turn, so each distinct word of a
    slice is encoded once; those not very long are remembered, up to a number.  Words end at
    spaces and line feeds only; other white space inside them is left to the tokenizer.

    Where the tokenizer lower-cases, parts words at letters and maps bytes, plain words
    of Latin letters, with or without ASCII marks behind, go to its model part by part.
    They are parted as a column, and only their distinct parts are remembered: in columns,
    too, ahead of the new ones, so that one hashing finds what is known and what is new.
    """

    MARKS = r"[!-&(-/:-@\[-^`{-~]*"
    PLAIN = re.compile(rf"([^\W\d_]+)({MARKS})")
    #: Of letters that are one code point each, in lower case and in NFC, too.
    LATIN = rf"^(?P<letters>[A-Za-z\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{F6}}\x{{F8}}-\x{{12F}}\x{{131}}-\x{{24F}}]+)(?P<marks>{MARKS})$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.held = pa.array([], pa.string())
        self.held_ids, self.held_sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        setup = json.loads(self.tokenizer.to_str())
        steps = [x.get("type") for k in ("normalizer", "pre_tokenizer") for x in _steps(setup[k])]
        self.parted = steps == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]
        self.shown = dict(zip(range(256), _byte_letters()))

    @property
    def parts(self) -> list[str]:
        """The remembered parts."""
        return self.held.to_pylist()

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else "".join(map(self.shown.__getitem__, part.encode()))
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _plain(self, word: str) -> bytes | None:
        m = self.PLAIN.fullmatch(word)
        if m is None or not m[1].isalpha() or max(word) >= "\u0250":
            return None
        letters = m[1].lower()
        if not word.isascii() and (len(letters) != len(m[1]) or not unicodedata.is_normalized("NFC", word)):
            return None
        return self._part(letters) + self._part(m[2])

    def _of_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the distinct parts, how many each has, and the place there of each part."""
        old = len(self.held)
        coded = pa.concat_arrays([self.held, parts]).dictionary_encode()
        # The remembered parts are distinct and come first: they keep their places.
        distinct, places = coded.dictionary, coded.indices.to_numpy()[old:]
        new_ids, new_sizes = _joined([self._part(p) for p in distinct.slice(old).to_pylist()])
        ids, sizes = np.concatenate([self.held_ids, new_ids]), np.concatenate([self.held_sizes, new_sizes])
        self._remember(distinct, ids, sizes, places)
        return ids, sizes, places

    def _remember(self, distinct: pa.Array, ids: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> None:
        stay = pc.less_equal(pc.utf8_length(distinct), REMEMBERED).to_numpy(zero_copy_only=False)
        if np.count_nonzero(stay) > MEMORY_WORDS:
            # Known parts that were just met stay: the common ones are among them.
            met = np.zeros(len(distinct), bool)
            met[places] = True
            stay &= met
        kept = np.flatnonzero(stay)[:MEMORY_WORDS]
        if len(kept) < len(distinct):
            begins = np.cumsum(sizes) - sizes
            distinct, ids, sizes = distinct.take(pa.array(kept)), ids[ragged(begins[kept], sizes[kept])], sizes[kept]
        self.held, self.held_ids, self.held_sizes = distinct, ids, sizes

    def _of_words(self, words: list[str]) -> list[bytes]:
        out = list(map(self.known.get, words))
        missing = [i for i, found in enumerate(out) if found is None]
        rest = missing
        if self.parted:
            for i in missing:
                out[i] = self._plain(words[i])
            rest = [i for i in missing if out[i] is None]
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for i, found in zip(some, self.tokenizer.encode_batch([words[i] for i in some], add_special_tokens=False)):
                out[i] = np.array(found.ids, np.uint32).tobytes()
        self.known = _remembered(self.known, words, out, missing)
        return out

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct words in one array, and how many each word has."""
        places = np.zeros((len(words), 2), np.int64)
        # The first part has no ids; words not parted are one part each.
        ids, sizes, plain = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], np.zeros(len(words), bool)
        if self.parted:
            split = pc.extract_regex(words, self.LATIN)
            plain = split.is_valid().to_numpy(zero_copy_only=False)
            split = split.drop_null()
            part_ids, part_sizes, found = self._of_parts(
                pa.concat_arrays([pc.utf8_lower(split.field("letters")), split.field("marks")])
            )
            places[plain] = found.reshape(2, -1).T + 1
            ids.append(part_ids)
            sizes.append(part_sizes)
        rest_ids, rest_sizes = _joined(self._of_words(words.filter(pa.array(~plain)).to_pylist()))
        places[~plain, 0] = np.arange(len(rest_sizes)) + sum(map(len, sizes))
        sizes = np.concatenate([*sizes, rest_sizes])
        per_part = sizes[places]
        begins = (np.cumsum(sizes) - sizes)[places]
        return np.concatenate([*ids, rest_ids])[ragged(begins.ravel(), per_part.ravel())], per_part.sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many each text has."""
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = pc.dictionary_encode(words.flatten())
        ids, sizes = self._distinct(coded.dictionary)
        begins, codes = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        # A stretch of the words at a time: places take several times the room of ids.
        flat = [
            ids[ragged(begins[some], sizes[some])]
            for some in (codes[at : at + WORK_WORDS] for at in range(0, len(codes), WORK_WORDS))
        ]
        per_text = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        sums = np.concatenate([[0], np.cumsum(sizes[codes])])
        ends = np.cumsum(per_text)
        return np.concatenate([np.zeros(0, np.uint32), *flat]), sums[ends] - sums[ends - per_text]


def _joined(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in one array, and how many each has."""
    return np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4


def _remembered(held: dict[str, bytes], words: list[str], found: list[bytes], new: list[int]) -> dict[str, bytes]:
    """`held` with the new ones of `words`, half of `MEMORY_WORDS` at most."""
    most = MEMORY_WORDS // 2
    if len(held) + len(new) > most:
        # Known words that were just met stay: the common ones are among them.
        held = {w: f for w, f in zip(words, found) if w in held}
    short = (i for i in new if len(words[i]) <= REMEMBERED)
    held.update((words[i], found[i]) for i in islice(short, most - len(held)))
    return held


def _steps(setup: dict | None) -> list[dict]:
    if setup is None:
        return []
    return setup.get("normalizers") or setup.get("pretokenizers") or [setup]


def _byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: itself where it is printable."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def vectors(ids: np.ndarray, counts: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Mean of the ids' hashed signs, a row per document; zero where there are no ids."""
    out = np.zeros((len(counts), dimensions))
    full = np.flatnonzero(counts)
    if len(full):
        bits = mixed(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        begins = (np.cumsum(counts) - counts)[full]
        for d in range(dimensions):
            signs = ((bits >> np.uint64(d)) & np.uint64(1)).astype(np.int32) * 2 - 1
            out[full, d] = np.add.reduceat(signs, begins) / counts[full]
    return out


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places along the Hilbert curve of integer points, a row each (Skilling's method)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    spread = np.tanh(2.5 * vectors(ids, counts))
    return hilbert_keys(np.minimum(((spread + 1) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


TOKENS = "doc_id long, key long, n long, ids binary"
_encoders: dict[str, Encoder] = {}


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.setdefault(path, Encoder(path)) if path not in _encoders else _encoders[path]
        narrow = encoder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        for part in slices(batches, "text", LOOKUP_BYTES):
            all_ids, all_counts = encoder.encode(part.column("text"))
            for some in slices([part], "text", WORK_BYTES):
                counts, all_counts = np.split(all_counts, [some.num_rows])
                ids, all_ids = np.split(all_ids, [counts.sum()])
                keys = curve_keys(ids, counts)
                data = np.insert(ids, np.cumsum(counts), end_id).astype("<u2" if narrow else "<u4")
                sizes = (counts + 1) * data.itemsize
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                packed = pa.Array.from_buffers(
                    pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())]
                )
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(keys), pa.array(counts + 1), packed], ["doc_id", "key", "n", "ids"]
                )

    return run


def tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Per document: `row`, doc_id, curve key, id count and ids (little-endian); stored."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    found = texts.mapInArrow(_tokenize(tokenizer, end_id), TOKENS)
    return stored(found.withColumn("row", F.monotonically_increasing_id()), "tokens")


def places(found: DataFrame) -> tuple[DataFrame, int]:
    """(row, first) for each document along the curve, and the number of all ids."""
    spark = found.sparkSession
    keys = found.select("row", "doc_id", "key", "n")
    parts = max(1, -(-keys.count() // SORT_ROWS), spark.sparkContext.defaultParallelism)
    order = ["key", "doc_id", "row"]
    dealt = stored(
        keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "curve"
    )
    sums = dealt.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    before, total = [], 0
    for s in sums:
        before.append((s["part"], total))
        total += s["n"]
    # A row for each partition of the sort.
    ahead = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(ahead, "part").select(
        "row", (F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("first")
    )
    return placed, total


def cuts(total: int, limit: int) -> np.ndarray:
    """Starts of the sequences in the last, incomplete stretch, and the end."""
    at, left, out = total - total % limit, total % limit, []
    while left:
        out.append(at)
        size = 1 << (left.bit_length() - 1)
        at, left = at + size, left - size
    return np.array([*out, total], np.int64)


def _cut(total: int, limit: int, width: int, with_ids: bool):
    tail = cuts(total, limit)
    whole_sequences = total // limit

    def edges(first: int, end: int) -> list[int]:
        inner = range((first // limit + 1) * limit, min(end, whole_sequences * limit + 1), limit)
        last = tail[(tail > max(first, whole_sequences * limit)) & (tail < end)].tolist()
        return [first, *(x for x in inner if x < end), *last, end]

    def sequence(at: int) -> tuple[int, int]:
        if at < whole_sequences * limit:
            return at // limit, at % limit
        k = int(np.searchsorted(tail, at, "right")) - 1
        return whole_sequences + k, at - int(tail[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, first, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "first", "n", "ids"))):
                ids = np.frombuffer(data, "<u2" if width == 2 else "<u4").astype("<u4")
                marks = edges(first, first + n)
                for a, b in zip(marks, marks[1:]):
                    number, offset = sequence(a)
                    piece = ids[a - first : b - first]
                    rows.append(
                        (doc, a - first, b - a, zlib.crc32(piece.tobytes()), n, number, offset)
                        + ((piece.tolist(),) if with_ids else ())
                    )
            names = PIECES.names + ["ids"] * with_ids
            kinds = [pa.int64()] * len(PIECES.names) + [pa.list_(pa.int64())] * with_ids
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


PIECES = pa.schema(
    [(x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    limit: int = LIMIT,
    end_id: int = END_ID,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents, in sequences of at most `limit` ids.

    `tokenizer` is a tokenizers file that executors can open, of a tokenizer that
    breaks at white space; `limit` is a power of two.  Columns: those of PIECES, and
    `ids` if asked for.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    found = tokens(picked(docs, doc_id=id_col, text=text_col), tokenizer, end_id)
    placed, total = places(found)
    sample = found.select("ids", "n").first()
    width = 4 if sample is None else len(sample["ids"]) // sample["n"]
    schema = ", ".join(f"`{c}` long" for c in PIECES.names) + (", ids array<long>" if with_ids else "")
    return found.join(placed, "row").select("doc_id", "first", "n", "ids").mapInArrow(
        _cut(total, limit, width, with_ids), schema
    )
