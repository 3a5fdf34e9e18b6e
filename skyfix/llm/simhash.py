"""SimHash near-duplicates, candidates found by Golay-code fuzzy hashing.

A text's fingerprint has the majority bit of the XXH64 hashes of its word shingles.
Two fingerprints link at ``MAX_BITS`` (4) or fewer differing bits. Candidates:

* The 64 bits are cut into five segments. At most four differing bits leave at least one
  segment untouched (pigeonhole): its bits are the exact half of a key.
* Of the other 51 or 52 bits, two groups of 23 are taken. One of them holds at most two
  of the four errors (pigeonhole again). It is read as a word of the binary Golay code
  [23, 12, 7] and decoded to every codeword within distance 4: one codeword for a word
  near a codeword, six for a word at distance 3. Two words at distance 2 or less always
  share such a codeword, whose 12-bit index is the fuzzy half of the key.

So any two fingerprints that link share a key (about 53 keys each), while unrelated ones
meet with probability 2**-25 a key. Candidates are joined on the key and verified by their
differing bits (see ``homes_of`` for large groups). Equal fingerprints are one class from the start, so a group of copies is
one row in the join however large it is. Components come from ``components``.

Defined results: a null or blank text has fingerprint zero and links like any other;
fewer words than a shingle give one shingle, the whole sequence; repeated ids keep their
rows; an empty table gives an empty result; other columns are ignored. Rows whose id is
null are fingerprinted and take their component from the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, first_of_each, identified
from .shared import columns, merged, sliced, written

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
SEGMENTS = 5
#: Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the code.
GENERATOR = 0b101011100011


def fingerprint_bits(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text as an unsigned 64-bit integer."""
    import xxhash

    words = text.lower().split()  # ASCII case and ASCII white space only, as bytes
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - width + 1)
    last = ends[-1:] if len(words) < width else ends[width - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(first[:n].tolist(), (last - 1).tolist())), np.uint64, n)
    # How often each value of each of the eight bytes occurs gives the count of every bit.
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(by_byte[:, j], minlength=256) @ BITS_OF_BYTES for j in range(8)])
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


#: The eight bits of each value of a byte.
BITS_OF_BYTES = (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``bits``: the fingerprint as a signed long."""
    rows = columns(df, doc_id=id_col, text=text_col)
    rows = rows.withColumn("text", rows["text"].cast("binary"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            bits = np.fromiter((fingerprint_bits(t or b"") for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "bits"])

    return rows.mapInArrow(run, f"doc_id {kind}, bits long")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    left = words.astype(np.int64)
    for i in range(22, 10, -1):
        left = np.where((left >> i) & 1, left ^ (GENERATOR << (i - 11)), left)
    return left


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: up to six error patterns that lead to codewords within distance 4; how many.

    The code is perfect: each syndrome has one pattern of weight 3 or less, its leader. If
    that has weight 3, the codewords at distance 4 come from the five codewords of weight 7
    that cover it.
    """
    bits = 1 << np.arange(23, dtype=np.int64)
    patterns = [np.zeros(1, np.int64), bits]
    patterns += [np.array([a | b for i, a in enumerate(bits) for b in bits[:i]])]
    patterns += [np.array([a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]])]
    every = np.arange(1 << 12, dtype=np.int64) << 11
    codewords = every | _syndromes(every)
    sevens = codewords[np.bitwise_count(codewords) == 7]
    table, many = np.zeros((1 << 11, 6), np.int64), np.ones(1 << 11, np.int64)
    for p in np.concatenate(patterns):
        s = int(_syndromes(np.array([p]))[0])
        table[s] = p
        if np.bitwise_count(p) == 3:
            table[s, 1:] = p ^ sevens[(sevens & p) == p]
            many[s] = 6
    return table, many


def golay_indices(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word six 12-bit codeword indices (rows) and how many of them count."""
    table, many = tables
    s = _syndromes(words)
    return (words[:, None] ^ table[s]) >> 11, many[s]


def fuzzy_keys(bits: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Keys of each fingerprint; any two within ``MAX_BITS`` bits share one."""
    u = bits.view(np.uint64)
    edges = [64 * i // SEGMENTS for i in range(SEGMENTS + 1)]
    found: list[list] = []
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        exact = ((u >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)
        below = u & np.uint64((1 << a) - 1)
        above = u >> np.uint64(b) if b < 64 else np.zeros_like(u)
        rest = below | (above << np.uint64(a))
        for half in range(2):
            word = ((rest >> np.uint64(23 * half)) & np.uint64((1 << 23) - 1)).astype(np.int64)
            index, many = golay_indices(word, tables)
            key = (((k * 2 + half) << 13 | exact)[:, None] << 12) | index
            found.append((key, many))
    keys, many = np.concatenate([k for k, _ in found], axis=1), np.stack([m for _, m in found], axis=1)
    counted = (np.arange(6)[None, None, :] < many[:, :, None]).reshape(len(u), -1)
    ends = np.concatenate([[0], np.cumsum(counted.sum(axis=1))])
    flat = keys[counted]
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _keyed(classes: DataFrame) -> DataFrame:
    """One row per key of each fingerprint: ``bits, home, key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = golay_tables()
        for batch in sliced(batches, 2048):
            keys = fuzzy_keys(np.asarray(batch.column(0)), tables)
            owner = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(flat, pa.int64())], names=["bits", "home", "key"])

    return classes.select("bits", "home").mapInArrow(run, "bits long, home long, key long")


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS


def homes_of(classes: DataFrame) -> DataFrame:
    """``bits, home``: fingerprints joined to the least and the greatest of each of their keys
    where they are near; ``home`` is the least fingerprint that can be reached so.

    A large group of near copies links nearly all with all. This joins it with as many rows
    as it has keys, and leaves little for the full join of ``links``.
    """
    labels = classes.select(F.col("bits").alias("node"), F.col("bits").alias("label"))
    found = components(star_pairs(classes), labels)
    return found.select(F.col("node").alias("bits"), F.col("label").alias("home"))


def links(homes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of homes of which any two fingerprints are at most ``MAX_BITS`` apart."""
    keyed = _keyed(homes)
    apart = (F.col("l.key") == F.col("r.key")) & (F.col("l.home") < F.col("r.home")) & _near("l.bits", "r.bits")
    return merged(keyed.alias("l"), keyed.alias("r"), apart).select(F.col("l.home").alias("a"), F.col("r.home").alias("b")).distinct()


def star_pairs(classes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of near fingerprints, b the least or the greatest of a key that both have."""
    keyed = _keyed(classes.select("bits", F.col("bits").alias("home"))).drop("home")
    ends = written(keyed.groupBy("key").agg(F.min("bits").alias("lo"), F.max("bits").alias("hi")).where("lo < hi"), "ends")
    met = merged(keyed, ends, "key")
    stars = [met.where(_near("bits", end) & (F.col("bits") != F.col(end))).select(F.col("bits").alias("a"), F.col(end).alias("b")) for end in ("lo", "hi")]
    return stars[0].unionByName(stars[1])


def near_pairs(homes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of near fingerprints that have different homes."""
    keyed = _keyed(homes)
    apart = (F.col("l.key") == F.col("r.key")) & (F.col("l.home") < F.col("r.home")) & _near("l.bits", "r.bits")
    return merged(keyed.alias("l"), keyed.alias("r"), apart).select(F.col("l.bits").alias("a"), F.col("r.bits").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable)."""
    marked = written(fingerprints(df, id_col, text_col), "fingerprints")
    classes = written(marked.groupBy("bits").agg(F.min("doc_id").alias("least")), "classes")
    homes = written(homes_of(classes), "homes")
    least = merged(homes, classes, "bits").groupBy("home").agg(F.min("least").alias("label"))
    component = components(links(homes), written(least.withColumnRenamed("home", "node"), "least"))
    placed = merged(homes, component, F.col("home") == F.col("node")).select("bits", F.col("label").alias("component_id"))
    return merged(marked, written(placed, "placed"), "bits").select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each component: that with the smallest id, a null id last. Rows
    are told apart by id and text, so of repeated rows one stays."""
    found = near_duplicates(identified(df, id_col, text_col)).select("doc_id", "component_id")
    return first_of_each(df, found, id_col, text_col)
