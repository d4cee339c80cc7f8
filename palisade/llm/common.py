"""Helpers shared by the training-data operators: table reading, fold hashing, byte-level words."""

from __future__ import annotations

import struct
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id falls in no fold (null)."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


#: Rows of text that go to a Python worker at a time: texts are long, and several workers share a machine.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def stretches(texts: list, limit: int = 1_000_000) -> list[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters each; a longer text stands alone."""
    out, start, size = [], 0, 0
    for k, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if k > start and size + n > limit:
            out.append((start, k))
            start, size = k, 0
        size += n
    return [*out, (start, len(texts))] if len(texts) else out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; set here only where it is unset, in local mode."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if found is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="palisade-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def unused(name: str, columns: list[str]) -> str:
    """The name, or one like it, that no column has (Spark compares names without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder: the plan above it is never run again, even after an executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def byte_table(word: bytes | None = None, lower: bool = True) -> bytes:
    """A bytes.translate table: bytes outside ``word`` (default 0-9, a-z, A-Z, 128-255) become blanks."""
    keep = set(range(0x30, 0x3A)) | set(range(0x41, 0x5B)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
    if word is not None:
        keep = set(word)
    out = bytearray(b if b in keep else 0x20 for b in range(256))
    if lower:
        for b in range(0x41, 0x5B):
            if out[b] == b:
                out[b] = b + 32
    return bytes(out)


#: Words of ASCII letters and digits and all non-ASCII characters, lower-cased in A-Z only.
WORD_TABLE = byte_table()


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(WORD_TABLE).split() if text else []


#: Words are hashed by two polynomials modulo a prime.
_PRIME, _BASES = (1 << 31) - 1, (0x2C1B3C6D, 0x297A2D39)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo the prime."""
    out = np.ones(n, np.uint32)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more].astype(np.uint64) * np.uint64(pow(base, have, _PRIME)) % np.uint64(_PRIME)
        have += more
    return out


_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def word_spans(texts: list[bytes], table: bytes = WORD_TABLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Translated bytes of all texts, starts and ends of their words, and the words' offsets by text (n + 1 values)."""
    flat = np.frombuffer((b" " + b" ".join(texts) + b" ").translate(table), np.uint8)
    word = flat != 0x20
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    text_ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
    return flat, starts, ends, np.concatenate([[0], np.searchsorted(starts, text_ends, "right")])


def hash_spans(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """62-bit hashes of words, mixed, from prefix sums: equal words have equal hashes wherever they stand."""
    n, prime, both = len(flat), np.uint64(_PRIME), np.zeros(len(starts), np.uint64)
    for base in _BASES:
        if base not in _POW or len(_POW[base][0]) < n:
            size = 1 << (n - 1).bit_length()
            _POW[base] = _powers(base, size), _powers(pow(base, -1, _PRIME), size)
        up, down = _POW[base]
        sums = (flat.astype(np.uint64) + np.uint64(1)) * up[:n]
        if n > 1 << 23:  # else the sums stay below 2**64
            sums %= prime
        np.cumsum(sums, out=sums)
        one = (sums[ends - 1] - sums[starts - 1]) % prime * down[starts] % prime
        both = (both << np.uint64(31)) | one
    return mix64(both) + (ends - starts).astype(np.uint64)


def hash_words(texts: list[bytes], table: bytes = WORD_TABLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and the words' offsets by text."""
    flat, starts, ends, offsets = word_spans(texts, table)
    return hash_spans(flat, starts, ends), offsets


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers as byte planes, which compress well."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a, "<u8")
        width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        out += [struct.pack("<IB", len(a), width), a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    at, out = 1, []
    for _ in range(data[0]):
        n, width = struct.unpack_from("<IB", data, at)
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 5).reshape(width, n).T
        out.append(a.view("<u8")[:, 0])
        at += 5 + n * width
    return out


def kept(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read back: as :func:`cut`, but compressed columns."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
