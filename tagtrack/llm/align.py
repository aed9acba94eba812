"""Alignment of two tokenizers over the same bytes.

No token of either side reaches from a character that is no white space into the space after it (read
off the vocabulary and the splitting rule; else a text is one unit). So a text is a row of *units*, cut
before such spaces, whose tokens, groups and links do not depend on their neighbours: every
distinct unit of a batch is tokenised and aligned once, all of them in one go, and a document is put together from its units.

The tokens of A and of B cut one byte string in two ways. The least groups that both
cuts have in common are found by pointer jumping: every token points to the farthest-right token of the
other side that it overlaps, if that one ends later, else to itself; doubling the
pointers of all tokens of a batch (``p = p[p]``) ends, after the logarithm of the longest chain, at the
token where both sides end together. That terminal token labels the group.

An id pair (a, b) is linked where a token a of A and a token b of B overlap; its count is the
number of documents in which it is linked. Links of a text are kept as its distinct pairs with their
times, written once, so texts are tokenised once. Counts meet the documents again in two
ways, by a bound that does not depend on the corpus: the ``HEAD`` most frequent pairs at most (16 bytes each)
are broadcast and looked up in tasks, and the rest, which few documents hold, are joined by a shuffle.

Defined results: a text that is NULL or empty, or whose tokens do not give its bytes back on
either side, has no tokens; a repeated row is another document; NULL ids are ids; other columns play no part.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtrack.llm.common import saved

FOLDER = "/opt/tokenizers"
FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: pairs that are broadcast at most, characters of texts taken at once, distinct pairs a task holds before it passes them on
HEAD, BATCH_BYTES, HELD = 1 << 20, 1 << 20, 1 << 21
#: units a task remembers
KNOWN = 400_000


def _byte_letters() -> dict[str, int]:
    """The letters of byte-level vocabularies: printable Latin-1 for itself, the other bytes from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@dataclass
class Side:
    """A tokenizer: ids of texts, and the bytes of every id."""

    encode: Callable[[list[str]], list[list[int]]]  # of texts with the space before them
    tokens: list[bytes]
    by_unit: bool  # no token holds a space after another character
    lengths: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)


def byte_level(path: str) -> Side:
    """A byte-level BPE: a space goes before the text; special tokens' strings are plain text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    letters = _byte_letters()
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    tokens = [b""] * model.get_vocab_size()
    for piece, i in said["model"]["vocab"].items():
        if all(c in letters for c in piece):
            tokens[i] = bytes(letters[c] for c in piece)
    splits = said.get("pre_tokenizer") or {}
    apart = splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not said.get("normalizer")
    return Side(lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)], tokens, apart)


def pieces(path: str) -> Side:
    """A piece BPE with byte fallback, which puts the space before the text itself."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        tokens.append(bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode())
    apart = not any(b" " in t.lstrip(b" ") for t in tokens)
    space = [model.piece_to_id("▁")]

    def encode(texts: list[str]) -> list[list[int]]:
        ids = model.encode([t[1:] for t in texts], num_threads=1)  # the space is put back, but not before nothing
        return [i if len(t) > 1 else space for t, i in zip(texts, ids, strict=True)]

    return Side(encode, tokens, apart)


def side(path: str) -> Side:
    """The tokenizer of a file; loaded in every task, as a model with its settings does not travel."""
    return pieces(path) if path.endswith(".model") else byte_level(path)


def labels(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terminal token of the group of every token, by pointer jumping; A's tokens are 0.. and B's come after them.

    ``ends_*`` rise, and the last of both is the same.
    """
    n = len(ends_a)
    starts_a, starts_b = np.append(0, ends_a[:-1]), np.append(0, ends_b[:-1])
    # the last token of the other side that begins before this one ends overlaps it, and lies farthest right
    to_b = np.searchsorted(starts_b, ends_a) - 1
    to_a = np.searchsorted(starts_a, ends_b) - 1
    here = np.arange(n + len(ends_b))
    point = np.concatenate([to_b + n, to_a])
    ends = np.concatenate([ends_a, ends_b])
    point = np.where(ends[point] > ends, point, here)
    # where both end together B's token stands for the group
    both = (point[:n] == here[:n]) & (ends_b[to_b] == ends_a)
    point[:n] = np.where(both, to_b + n, point[:n])
    while True:
        far = point[point]
        if np.array_equal(far, point):
            return point[:n], point[n:]
        point = far


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places (in A, in B) of all pairs of tokens whose byte ranges overlap."""
    starts_a, starts_b = np.append(0, ends_a[:-1]), np.append(0, ends_b[:-1])
    first = np.searchsorted(ends_b, starts_a, "right")
    many = np.searchsorted(starts_b, ends_a) - first
    ends = np.cumsum(many)
    a = np.repeat(np.arange(len(ends_a)), many)
    return a, np.repeat(first - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)


class Writer:
    """The text of groups: `a1,a2|b1;a3|b2,b3`."""

    def __init__(self, ids: int) -> None:
        self.parts = {mark: np.array([f"{i}{mark}" for i in range(ids)], object) for mark in ",|;"}

    def __call__(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> str:
        group = np.concatenate([group_a, group_b])
        kind = np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((kind, group))  # stable: order inside a side stays
        group, kind, ids = group[order], kind[order], np.concatenate([a, b])[order]
        out = self.parts[","][ids]
        turn = np.append(kind[:-1] != kind[1:], False) & (kind == 0)
        last = np.append(group[:-1] != group[1:], False)
        out[turn], out[last] = self.parts["|"][ids[turn]], self.parts[";"][ids[last]]
        return "".join(out.tolist())[:-1]  # without the comma of the last id


def _checked(side: Side, units: list[str], want: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all units, how many each has, and whether they give the unit's bytes back."""
    ids = side.encode(units)
    many = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = list(chain.from_iterable(ids))
    out = np.array(flat, np.int64)
    joined = b"".join(map(side.tokens.__getitem__, flat))
    bounds = np.append(0, np.cumsum(side.lengths[out]))[np.append(0, np.cumsum(many))]
    fine = np.diff(bounds) == np.fromiter(map(len, want), np.int64, len(want))
    if not fine.all() or joined != b"".join(want):
        cut = bounds.tolist()
        fine &= np.array([joined[i:j] == w for i, j, w in zip(cut[:-1], cut[1:], want, strict=True)], bool)
    return out, many, fine


class Units:
    """Tokens, groups and links of the distinct units seen by a task, made once each."""

    def __init__(self, first: Side, second: Side) -> None:
        self.a, self.b = first, second
        self.write, self.wide = Writer(max(len(first.tokens), len(second.tokens))), len(second.tokens)
        self.cut = re.compile(r"(?<=\S)(?= )") if first.by_unit and second.by_unit else None
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.said: list[str] = []  # groups as text
        self.counts = np.zeros((0, 5), np.int64)  # tokens of A, of B, groups, links, 1 where the bytes do not come back
        self.pairs, self.starts = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def of(self, text: str) -> list[str]:
        return [" " + text] if self.cut is None else self.cut.split(" " + text)

    def learn(self, units: list[str]) -> None:
        want = [u.encode() for u in units]
        (ids_a, n_a, fine), (ids_b, n_b, also) = (_checked(s, units, want) for s in (self.a, self.b))
        fine &= also
        ids_a, ids_b = ids_a[np.repeat(fine, n_a)], ids_b[np.repeat(fine, n_b)]
        n_a, n_b = n_a * fine, n_b * fine
        ends_a, ends_b = np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.b.lengths[ids_b])
        counts = np.zeros((len(units), 5), np.int64)
        counts[:, 0], counts[:, 1], counts[:, 4] = n_a, n_b, ~fine
        said, pairs = [""] * len(units), np.zeros(0, np.int64)
        if len(ids_a):
            group_a, group_b = labels(ends_a, ends_b)
            at_a, at_b = links(ends_a, ends_b)
            pairs = ids_a[at_a] * self.wide + ids_b[at_b]
            unit = np.repeat(np.arange(len(units)), n_a)
            ends = np.unique(group_b - len(ids_a))  # the last token of B of every group
            counts[:, 2] = np.bincount(np.repeat(np.arange(len(units)), n_b)[ends], minlength=len(units))
            counts[:, 3] = np.bincount(unit[at_a], minlength=len(units))
            parts, bounds = self.write(ids_a, ids_b, group_a, group_b).split(";"), np.cumsum([0, *counts[:, 2]]).tolist()
            said = [";".join(parts[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        for u in units:
            self.place[u] = len(self.place)
        self.said += said
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts[:, 3])])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.counts = np.concatenate([self.counts, counts])

    def documents(self, texts: list[str], keep_groups: bool) -> list[pa.Array]:
        """n_a, n_b, n_groups, n_links, groups (or their digest), pairs, times of every text."""
        if len(self.place) > KNOWN:
            self.forget()
        units = [self.of(t) if t else [] for t in texts]
        new = list(dict.fromkeys(u for us in units for u in us if u not in self.place))
        if new:
            self.learn(new)
        places = [[self.place[u] for u in us] for us in units]
        many = np.array([len(p) for p in places])
        at = np.fromiter(chain.from_iterable(places), np.int64, int(many.sum()))
        doc = np.repeat(np.arange(len(texts)), many)
        counts = np.zeros((len(texts), 5), np.int64)
        np.add.at(counts, doc, self.counts[at])
        lost = (counts[:, 4] > 0) | (many == 0)
        counts[lost] = 0
        at, doc = at[~lost[doc]], doc[~lost[doc]]
        first, n = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(n)
        pair = self.pairs[np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        key = np.sort(np.repeat(doc, n) * (len(self.a.tokens) * self.wide) + pair)
        new_key = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.append(new_key, len(key)))
        own, pair = np.divmod(key[new_key], len(self.a.tokens) * self.wide)
        groups = ["" if x else ";".join([self.said[i] for i in p]) for p, x in zip(places, lost.tolist(), strict=True)]
        if not keep_groups:
            groups = [hashlib.sha256(g.encode()).hexdigest() for g in groups]
        bounds = pa.array(np.searchsorted(own, np.arange(len(texts) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(v)) for v in (pair, times.astype(np.int32))]
        return [*(pa.array(counts[:, k]) for k in range(4)), pa.array(groups, pa.string()), *lists]


ROWS = "id {id}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def _tokenised(first: str, second: str, keep_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(side(first), side(second))
        for batch in batches:
            texts = batch.column("text")
            sizes = np.cumsum([len(t) if t else 0 for t in texts.to_pylist()]) // BATCH_BYTES
            cuts = (np.flatnonzero(np.diff(sizes)) + 1).tolist()
            for at, to in zip([0, *cuts], [*cuts, len(texts)], strict=True):
                if at < to:
                    made = units.documents([t or "" for t in texts.slice(at, to - at).to_pylist()], keep_groups)
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, to - at), *made], ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pair, n: in how many rows of a task a pair stands; passed on whenever HELD pairs have gathered."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting, held = [], 0

    def added() -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate([keys, *waiting])
        order = np.argsort(both, kind="stable")
        both, weight = both[order], np.concatenate([counts, np.ones(held, np.int64)])[order]
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, int)
        return both[first], np.add.reduceat(weight, first) if len(both) else counts

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])

    for batch in batches:
        flat = batch.column("pairs").flatten().to_numpy(zero_copy_only=False)
        waiting.append(flat)
        held += len(flat)
        if held >= HELD:
            keys, counts = added()
            waiting, held = [], 0
            if len(keys) >= HELD:
                yield out()
                keys, counts = keys[:0], counts[:0]
    keys, counts = added()
    yield out()


def _looked_up(keys: np.ndarray, counts: np.ndarray, best: np.ndarray, rest: bool):
    """Per row the sums over its frequent pairs, or (``rest``) its other pairs."""

    def split(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lists = batch.column("pairs")
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        pair = lists.flatten().to_numpy(zero_copy_only=False)
        times = batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
        return row, pair, times, at, (keys[at] == pair) if len(keys) else np.zeros(len(pair), bool)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _, times, at, known = split(batch)
            row, times, at = row[known], times[known], at[known]
            n = batch.num_rows
            total, top = np.zeros(n, np.int64), np.zeros(n, np.int64)
            if len(row):
                np.add.at(total, row, times * counts[at])
                np.add.at(top, row, times * best[at])
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(top), pa.array(total)], ["d", "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pair, times, _, known = split(batch)
            d = batch.column("d").to_numpy()[row[~known]]
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(pair[~known]), pa.array(times[~known])], ["d", "pair", "times"])

    return others if rest else sums


def _head(counts: DataFrame) -> DataFrame:
    """The most frequent pairs, at most HEAD of them: all above a frequency read off a histogram of some hundred steps."""
    step = F.floor(F.log2("n") * 16).cast("int")
    total, least = 0, None
    for s, n in sorted(((r["s"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        if total + n > HEAD:
            break
        total, least = total + n, s
    return counts.where(step >= least) if least is not None else counts.limit(0)


def aligned(df: DataFrame, id: str, text: str, folder: str = FOLDER, first: str = FIRST, second: str = SECOND, keep_groups: bool = False) -> DataFrame:
    """A row per document: its id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and groups where asked for (else NULL).

    ``n_best`` are the links whose count is the highest of their A id in the corpus, ``count_sum`` is the sum of the counts of all links.
    """
    paths = f"{folder}/{first}", f"{folder}/{second}"
    rows = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(_tokenised(*paths, keep_groups), ROWS.format(id=kind))
    tokens = saved(made.withColumn("d", F.monotonically_increasing_id()), "tokens")
    wide = len(side(paths[1]).tokens)
    counts = saved(tokens.select("pairs").mapInArrow(_summed, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    owner = F.expr(f"pair div {wide}L")
    top = counts.groupBy(owner.alias("a")).agg(F.max("n").alias("m"))
    marked = counts.withColumn("a", owner).join(top, "a").select("pair", "n", (F.col("n") == F.col("m")).cast("long").alias("best"))
    marked = saved(marked, "marked")
    head = _head(marked).toArrow()
    keys, order = head["pair"].to_numpy(), None
    order = np.argsort(keys)
    tables = [c.to_numpy()[order] for c in (head["pair"], head["n"], head["best"])]
    lists = tokens.select("d", "pairs", "times")
    near = lists.mapInArrow(_looked_up(*tables, False), "d long, n_best long, count_sum long")
    rest = lists.mapInArrow(_looked_up(*tables, True), "d long, pair long, times long").join(marked, "pair")
    far = rest.groupBy("d").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    sums = near.unionByName(far).groupBy("d").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    groups = F.when(F.col("n_links") == 0, F.lit("")).otherwise(F.sha2("groups", 256) if keep_groups else F.col("groups"))
    out = tokens.drop("pairs", "times").join(sums, "d").withColumn("groups_sha256", groups)
    said = F.col("groups") if keep_groups else F.lit(None).cast("string")
    return out.select(F.col("id").alias(id), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", said.alias("groups"))
