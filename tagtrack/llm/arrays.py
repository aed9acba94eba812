"""Token hashes of whole Arrow batches in numpy, for the operators that count n-grams in Python tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 18
#: of a batch that goes to Python, about: rows alone do not bound it, as texts have any length
BATCH_BYTES = 1 << 21
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
RADIX = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE, WORD, MARK = 0, 1, 2


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per byte: lower-cased A-Z; class of white-space words; class of words and runs of marks."""
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    plain = np.full(256, WORD, np.int8)
    plain[[9, 10, 11, 12, 13, 32]] = SPACE
    marked = np.full(256, MARK, np.int8)
    marked[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = WORD
    marked[[9, 10, 11, 12, 13, 32]] = SPACE
    return lower + np.uint64(1), plain, marked


LOWER, PLAIN, MARKED = _classes()
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def token_hashes(data: np.ndarray, starts: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of concatenated texts, and the bounds of each text's tokens.

    ``data`` are the bytes of all texts, ``starts`` their n + 1 offsets. A token is a run
    of one class other than SPACE; A-Z count as a-z.
    """
    n = len(data)
    kind = classes[data]
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:n])
    change[starts] = True
    edges = np.flatnonzero(change)
    first, last = edges[:-1], edges[1:]
    solid = kind[first] != SPACE
    first, last = first[solid], last[solid]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(LOWER[data] * _power("up", RADIX, n), out=total[1:])
    h = (total[last] - total[first]) * _power("down", INVERSE, n + 1)[first]
    return mix(h + (last - first).astype(np.uint64)), np.searchsorted(first, starts)


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about CHUNK_BYTES; a longer text is a run of its own."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        end = min(end, len(texts))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` for rows with texts. The session's batches hold about BATCH_BYTES from now on; a smaller limit stays.

    Without it a batch is 10,000 rows or 64 MB, and an executor keeps several copies of one for each of its tasks.
    """
    conf = df.sparkSession.conf
    in_bytes = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if in_bytes(conf.get(BATCH_LIMIT, "64m")) > BATCH_BYTES:
        conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def with_columns(df: DataFrame, text: str, fn: Callable[[pa.Array], list[pa.Array]], out: str, keep_text: bool = True) -> DataFrame:
    """``df`` with the columns of the schema text ``out``, which ``fn`` makes from a batch of ``text`` (NULL as empty)."""
    added = [p.strip().split(" ", 1)[0] for p in out.split(",")]
    kept = [c for c in df.columns if c.lower() not in {a.lower() for a in added} and (keep_text or c != text)]
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    if kept.count(text) == 1 and dict(df.dtypes)[text] == "string":  # a text that is kept goes to Python once
        at, last = kept.index(text), len(kept)
        rows = rows.drop("_text")
    else:
        at = last = len(kept)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:last]] + [out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names[:last]
            made = fn(batch.column(at).fill_null(""))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made], [*names, *added])

    done = mapped(rows, run, schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *added)
