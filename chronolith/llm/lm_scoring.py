"""Language-model scores by online logistic context mixing over the words of a text.

A text is its tokens: words without white space, A-Z in lower case, and an end. Each token is coded by binary decisions,
and each decision by a mixer of several predictors with gated weights and an adaptive map after it (``bit_mixing``):

* *Matches*: is the token the one that followed the two words before when they last stood in this document; is it the
  one that follows them in more than half of their places in the corpus; the same for the one word before. Each is one
  bit. Its predictors are what such bits were after as many matches in a row, after contexts seen as often, in
  documents of the kind, and after both.
* *Code*: if no match, a binary code of the ``BOOK`` commonest tokens and an escape, bit by bit down a tree. Its
  predictors are the counts below each node in all texts, in those of the same commonest word, of the same commonest
  letter beyond ASCII, and of both (the kind of a document, which is paid for).
* *Escapes*: whether the token occurs in the corpus (then by its share of such tokens), else it is spelled: bits of
  bytes, whose predictors are hashed contexts of 1, 2, 3, 4 and 6 bytes and the whole word so far.

All counts are those of all training texts. A training text is scored with one occurrence of each of its own tokens and
n-grams left out, so scores of training and held-out texts compare; mixers and maps learn from training texts alone.

n-grams of one to three words are counted over the corpus by their hashes. Texts are read once into blocks of documents.
A block sends its sorted hashes and counts to hash buckets as packed arrays and gets the totals back in the same order,
so common words and contexts are pre-aggregated, and no bucket depends on one key. The number of buckets follows the
size of the texts. What tasks or the driver hold as a whole is of fixed size: the book, ``KINDS`` kinds, the matches'
cells, and the speller's tables.

Defined cases: a null text is empty, its only token is the end; a null id is a training id; repeated rows each count
and each get a row; an empty table gives an empty result; without training tokens all bits are even.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.bit_mixing import CHUNK, END, ORDERS, TABLE_BITS, Mixer, Speller, count_bits, learn_events, spelling_step, squash, stretched
from chronolith.llm.common import written

#: Bytes of text in a block of documents, n-grams in a bucket, and tokens whose decisions are made at a time, about.
BLOCK_BYTES, BUCKET_GRAMS, SLICE_TOKENS = 6 << 20, 1_500_000, 1 << 17
#: Tokens with a code of their own.
BOOK = (1 << 16) - 1
#: Kinds of documents; the last one is for all others.
KINDS = 32
#: Steps of matches in a row, and of the places of a context.
RUNS, PLACES = np.array([1, 2, 3, 5, 9, 17]), np.array([1, 2, 3, 5, 9, 33, 129, 1025])
OWN, TWO, ONE, KNOWN = range(4)
CELLS = 4 * 2 * (len(RUNS) + 1) * (len(PLACES) + 1) * KINDS
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_EVEN = ~np.uint64(1)
_BEFORE = np.uint64(0xA0761D6478BD642F)  # stands for words before the text


def tokens(text: bytes | None) -> list[bytes]:
    out = text.lower().split() if text else []
    out.append(END)
    return out


# packed arrays ----------------------------------------------------------------------------------------------------


_ZSTD = pa.Codec("zstd", compression_level=1)


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def expand(data: bytes) -> bytes:
    return _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def pack(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of unsigned numbers, compressed plane by plane, as equal bytes lie together there."""
    return squeeze(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(expand(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)), 8)


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, 8), dtype=np.uint64)


# n-grams ----------------------------------------------------------------------------------------------------------


def token_hashes(toks: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, toks), np.uint64, len(toks)) & _EVEN


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M[3]
    return (x ^ (x >> np.uint64(29))) * _M[0]


def gram_hashes(t: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the two and the three words that end at each token; ``first``: where documents begin."""
    one, two = np.full(len(t), _BEFORE), np.full(len(t), _BEFORE)
    one[1:], two[2:] = t[:-1], t[:-2]
    one[first] = two[first] = _BEFORE
    second = first[first + 1 < len(t)] + 1
    two[second] = _BEFORE
    return _mixed(one * _M[1] + t) & _EVEN, _mixed(_mixed(two * _M[2] + one) + t * _M[1]) & _EVEN


def _counted(h: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and how often each occurs outside held-out texts."""
    s = np.sort(h | out)
    new = np.flatnonzero(np.concatenate([[True], (s[1:] & _EVEN) != (s[:-1] & _EVEN)])) if len(s) else np.zeros(0, np.int64)
    train = np.concatenate([[0], np.cumsum(1 - (s & np.uint64(1)).astype(np.int64))])
    return s[new] & _EVEN, np.diff(train[np.append(new, len(s))])


class _Numbers(dict):
    """Numbers of words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def commonest_letter(text: bytes) -> int:
    """The first two bytes of the commonest letter beyond ASCII; 0 if there is none."""
    a = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(a[:-1] >= 0xC0) if len(a) else a
    if not len(at):
        return 0
    pair, n = np.unique(a[at].astype(np.int32) * 256 + a[at + 1], return_counts=True)
    return int(pair[n.argmax()])


def _blocks(rows: DataFrame) -> DataFrame:
    """doc_id, held_out, text -> a row per block of documents, with its distinct tokens and its documents' token numbers."""
    id_type = dict(rows.dtypes)["doc_id"]
    schema = f"block long, tokens binary, ids binary, doc_id array<{id_type}>, held_out array<boolean>, n_bytes array<long>, length array<long>, top array<long>, letter array<int>"

    def close(block: int, number: dict, docs: list, arrow_id: pa.DataType) -> pa.RecordBatch:
        toks = list(number)
        th, top = token_hashes(toks), []
        for d in docs:
            w, n = np.unique(d[4][:-1], return_counts=True)
            top.append(int(th[w[n == n.max()]].min().view(np.int64)) if len(w) else 0)
        ids = pack(np.concatenate([d[4] for d in docs]), 3 if len(toks) < 1 << 24 else 4)
        row = [block, squeeze(b" ".join(toks)), ids, *([d[i] for d in docs] for i in range(3)), [len(d[4]) for d in docs], top, [d[3] for d in docs]]
        types = [pa.int64(), pa.binary(), pa.binary(), *map(pa.list_, (arrow_id, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=[x.split()[0] for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number, docs, size, kind = TaskContext.get().partitionId() << 32, _Numbers(), [], 0, None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc_id, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text")):
                text = text.as_py() or b""
                ids = np.array([*map(number.__getitem__, tokens(text))], np.int32)
                docs.append((doc_id, out, len(text), commonest_letter(text), ids))
                size += len(text) + 64
                if size > BLOCK_BYTES:
                    yield close(block, number, docs, kind)
                    block, number, docs, size = block + 1, _Numbers(), [], 0
        if docs:
            yield close(block, number, docs, kind)

    return rows.mapInArrow(run, schema)


def _texts(block: dict) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, their hashes, the documents' token numbers one after the other, and the documents' lengths."""
    toks = expand(block["tokens"]).split(b" ")
    ids = unpack(block["ids"], 3 if len(toks) < 1 << 24 else 4).astype(np.int64)
    return toks, token_hashes(toks), ids, np.array(block["length"])


def _sent(blocks: DataFrame, bits: int, longer: bool) -> DataFrame:
    """For each block and bucket of hashes, its distinct tokens (or its two and three words in a row), with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                toks, th, ids, length = _texts(block)
                out = np.repeat(np.array(block["held_out"], np.uint64), length)
                if longer:
                    each = [_counted(h, out) for h in gram_hashes(th[ids], np.cumsum(length) - length)]
                else:
                    order = np.argsort(th)
                    each = [(th[order], np.bincount(ids, 1.0 - out, len(toks)).astype(np.int64)[order])]
                edges = [np.append(np.searchsorted(k >> np.uint64(64 - bits), np.arange(1 << bits, dtype=np.uint64)) if bits else [0], len(k)) for k, _ in each]
                if longer:  # 32 bits tell those of one bucket apart, about one in thousands wrongly
                    each = [((k << np.uint64(bits)) >> np.uint64(32), n) for k, n in each]
                rows = []
                for b in range(1 << bits):
                    part = [(k[e[b] : e[b + 1]], n[e[b] : e[b + 1]]) for (k, n), e in zip(each, edges)]
                    if any(len(k) for k, _ in part):
                        rows.append([block["block"], b, [pack_sorted(k) for k, _ in part], [pack(n, 4) for _, n in part]])
                for at in range(0, len(rows), 64):
                    types = (pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64]), types)], names=["block", "bucket", "keys", "times"])

    return blocks.select("block", "tokens", "ids", "held_out", "length").mapInArrow(run, "block long, bucket int, keys array<binary>, times array<binary>")


def _totals(sent: DataFrame, longer: bool) -> DataFrame:
    """For each block and bucket the totals of what it sent; for tokens also each bucket's figures, with a null block."""
    schema = "bucket int, block long, totals array<binary>, distinct long, total long, book binary, often binary"
    types = [pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def add(key: tuple, table: pa.Table) -> pa.Table:
        keys, times, back = table.column("keys").to_pylist(), table.column("times").to_pylist(), []
        k = n = np.zeros(0, np.uint64)
        for g in range(len(keys[0])):
            own = [unpack_sorted(x[g]) for x in keys]
            k, n = np.concatenate(own), np.concatenate([unpack(x[g], 4) for x in times]).astype(np.int64)
            order = np.argsort(k)
            new = np.concatenate([[True], np.diff(k[order]) > 0])[: len(k)]
            at = np.flatnonzero(new)
            total = np.add.reduceat(n[order], at) if len(at) else n
            each = np.empty(len(k), np.int64)
            each[order] = total[np.cumsum(new) - 1]
            back.append([pack(x if not longer else np.minimum(x, (1 << 32) - 1), 4 if longer else 8) for x in np.split(each, np.cumsum([len(x) for x in own])[:-1])])
            k, n = k[order][at], total
        rows = [[key[0].as_py(), b, list(x), None, None, None, None] for b, x in zip(table.column("block").to_pylist(), zip(*back))]
        if not longer:
            often = np.lexsort((k, -n))[:BOOK]
            often = often[n[often] > 0]
            rows.append([key[0].as_py(), None, None, int((n > 0).sum()), int(n.sum()), k[often].tobytes(), n[often].tobytes()])
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in schema.split(", ")])

    return sent.groupBy("bucket").applyInArrow(add, schema)


# the code of common tokens ----------------------------------------------------------------------------------------


def split_nodes(counts: np.ndarray) -> np.ndarray:
    """lo, mid, hi and depth of the nodes of a binary tree over the leaves: each range is cut where its mass halves."""
    c, found = np.concatenate([[0.0], np.cumsum(counts)]), []
    lo, hi, depth = np.array([0]), np.array([len(counts)]), 0
    while len(lo):
        keep = hi - lo > 1
        lo, hi = lo[keep], hi[keep]
        half = (c[lo] + c[hi]) / 2
        mid = np.searchsorted(c, half)
        mid = np.where(np.abs(c[np.maximum(mid - 1, 0)] - half) < np.abs(c[np.minimum(mid, len(counts))] - half), mid - 1, mid)
        mid = np.clip(mid, lo + 1, hi - 1)
        found.append(np.stack([lo, mid, hi, np.full(len(lo), depth)]))
        lo, hi, depth = np.concatenate([lo, mid]), np.concatenate([mid, hi]), depth + 1
    return np.concatenate(found, 1)


@dataclass
class Kinds:
    """Documents by their commonest word and letter; the last kind is for all that aren't listed."""

    pairs: list[tuple[int, int]]
    times: np.ndarray

    def groups(self) -> list[np.ndarray]:
        """For each predictor the group of each kind: all, of the word, of the letter, of both."""
        out = [np.zeros(KINDS, np.int64)]
        for part in (0, 1):
            known = {v: i for i, v in enumerate(dict.fromkeys(p[part] for p in self.pairs))}
            out.append(np.array([*(known[p[part]] for p in self.pairs), *[len(known)] * (KINDS - len(self.pairs))]))
        return [*out, np.arange(KINDS)]

    def log_p(self) -> np.ndarray:
        return np.log((self.times + 0.5) / (self.times.sum() + 0.5 * KINDS))


def code_log_p(counts: np.ndarray, kinds: Kinds) -> np.ndarray:
    """Log-probability of each leaf in each kind by the mixer; ``counts``: kinds x leaves, the last leaf is the escape."""
    lo, mid, hi, depth = split_nodes(counts.sum(0) + 1e-3)
    out = np.zeros(counts.shape, np.float64)
    if not len(lo):
        return out
    sums = []
    for group in kinds.groups():
        total = np.zeros((int(group.max()) + 1, counts.shape[1]))
        np.add.at(total, group, counts)
        c = np.concatenate([np.zeros((len(total), 1)), np.cumsum(total, 1)], 1)
        sums.append((group, (c[:, mid] - c[:, lo]).astype(np.float32), (c[:, hi] - c[:, mid]).astype(np.float32)))
        del total, c
    used = np.flatnonzero(counts.sum(1) > 0)
    level = np.minimum(depth, 7) * 4

    def cells(kind: int, at: np.ndarray | slice, less0: int, less1: int) -> tuple[list[np.ndarray], np.ndarray]:
        n = [(np.maximum(zeros[g[kind], at] - less0, 0), np.maximum(ones[g[kind], at] - less1, 0)) for g, zeros, ones in sums]
        return [stretched(b, a) for a, b in n], level[at] + np.searchsorted([1, 10, 100], n[3][0] + n[3][1], "right")

    mixer = Mixer.start(32, 4)
    order = np.random.RandomState(1).permutation(len(lo))
    for again in (True, True, False):  # the map counts the last pass only
        for at in range(0, len(order), 512):
            nodes, x, sets, y, weight = order[at : at + 512], [], [], [], []
            for kind in used:
                for bit in (0, 1):  # each event is left out of its own counts
                    n = sums[3][1 + bit][kind, nodes]
                    own = nodes[n > 0]
                    inputs, at_set = cells(kind, own, 1 - bit, bit)
                    x.append(inputs)
                    sets.append(at_set)
                    y.append(np.full(len(own), bit))
                    weight.append(np.sqrt(n[n > 0]))
            if x:
                x, sets = [np.concatenate(v) for v in zip(*x)], np.concatenate(sets)
                mixer.learn(x, sets, np.concatenate(y), np.concatenate(weight), mixer.predict(x, sets))
        if again:
            mixer.map_counts[:] = 0
    table = mixer.table()
    for kind in range(KINDS):
        if kind not in used and kind > 0 and kind < KINDS - 1:
            continue
        x, sets = cells(kind, slice(None), 0, 0)
        p1 = np.clip(Mixer.refined(mixer.predict(x, sets), sets, table).astype(np.float64), 1e-9, 1 - 1e-9)
        a, b = np.log(1 - p1), np.log(p1)
        steps = np.zeros(counts.shape[1] + 1)
        np.add.at(steps, lo, a)
        np.add.at(steps, mid, b - a)
        np.add.at(steps, hi, -b)
        out[kind] = np.cumsum(steps)[:-1]
    return out


def match_log_p(hits: np.ndarray, misses: np.ndarray) -> np.ndarray:
    """Log-probabilities (cells x 2) of a miss and a hit in each cell of matches, by the mixer."""
    n_runs, n_places = len(RUNS) + 1, len(PLACES) + 1
    cell = np.arange(CELLS)
    kind, place = cell % KINDS, cell // KINDS % n_places
    run, own, flag = cell // KINDS // n_places % n_runs, cell // KINDS // n_places // n_runs % 2, cell // KINDS // n_places // n_runs // 2
    contexts = [flag * n_runs + run, flag * n_places + place, ((flag * 2 + own) * n_runs + run) * n_places + place, flag * KINDS + kind, (flag * n_places + place) * KINDS + kind]
    inputs = []
    for c in contexts:
        h, m = np.bincount(c, hits), np.bincount(c, misses)
        inputs.append(stretched(h, m)[c])
    sets = (flag * 2 + own) * 3 + np.minimum(run, 2)
    y, weight = np.repeat([0, 1], CELLS), np.concatenate([misses, hits])
    real = weight > 0
    mixer = learn_events([np.tile(x, 2)[real] for x in inputs], np.tile(sets, 2)[real], 24, y[real], np.sqrt(weight[real]), passes=30, batch=1 << 10)
    table, mixed = mixer.table(), mixer.predict(inputs, sets)
    p1 = np.clip(Mixer.refined(mixed, sets, table).astype(np.float64) if real.any() else squash(mixed.astype(np.float64)), 1e-6, 1 - 1e-6)
    return np.stack([np.log(1 - p1), np.log(p1)], 1)


# documents --------------------------------------------------------------------------------------------------------


@dataclass
class Book:
    """What every task needs: the coded tokens by hash, the code's log-probabilities by kind, kinds, and totals."""

    hashes: np.ndarray  # sorted
    ranks: np.ndarray
    kinds: Kinds
    total: int
    distinct: int
    tail: float
    codes: np.ndarray | None = None  # kinds x leaves

    def leaves(self, th: np.ndarray) -> np.ndarray:
        """The leaf of each token; the last one is the escape."""
        if not len(self.hashes):
            return np.zeros(len(th), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, th), len(self.hashes) - 1)
        return np.where(self.hashes[at] == th, self.ranks[at], len(self.hashes))

    def kind(self, top: list[int], letter: list[int]) -> np.ndarray:
        known = {p: i for i, p in enumerate(self.kinds.pairs)}
        return np.array([known.get(p, KINDS - 1) for p in zip(top, letter)], np.int64)


def decisions(th: np.ndarray, ids: np.ndarray, length: np.ndarray, train: np.ndarray, kind: np.ndarray, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, leaf: np.ndarray, escape: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The matches of some documents: their owner, cell and outcome, and which tokens no match gives.

    ``ids``: the documents' tokens one after the other; ``train``, ``kind``: by document; ``c1``: counts by token number;
    ``c2``, ``c3``: those of the two and three words that end at each token; ``leaf``: of each token.
    """
    first = np.cumsum(length) - length
    doc = np.repeat(np.arange(len(length)), length)
    at = np.arange(len(ids))
    inside = at != first[doc]
    less = train[doc].astype(np.int64)
    before = np.maximum(at - 1, 0)
    places2 = np.where(inside, c2[before] - less, 0)
    places1 = np.where(inside, c1[ids[before]] - less, 0)
    hit2 = (places2 > 0) & (2 * (c3 - less) > places2)
    hit1 = (places1 > 0) & (2 * (c2 - less) > places1)
    # the token after the last place of the same two words in the document; the first word of a text counts with none before it
    t = th[ids]
    pair, _ = gram_hashes(t, first)
    rank = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
    order = (np.sort((rank << np.uint64(32)) | at.astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    last = np.full(len(ids), -1, np.int64)
    same = (rank[order[1:]] == rank[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    last[order[1:][same]] = order[:-1][same]
    here = np.where(inside, last[before], -1)
    has_own = here >= 0
    hit0 = has_own & (ids[np.where(has_own, here + 1, 0)] == ids)
    matched = hit0 | hit2 | hit1
    missed = np.maximum.accumulate(np.where(~matched | ~inside, at, 0))
    run = np.where(inside, np.maximum(at - 1 - missed[before], 0), 0)
    run = np.searchsorted(RUNS, run, "right")
    n_runs, n_places = len(RUNS) + 1, len(PLACES) + 1
    kind_ = kind[doc]

    def cell(flag: int, own: np.ndarray, places: np.ndarray) -> np.ndarray:
        return (((flag * 2 + own) * n_runs + run) * n_places + np.searchsorted(PLACES, places, "right")) * KINDS + kind_

    ask0, ask2 = has_own, (places2 > 0) & ~hit0
    ask1 = (places1 > 0) & ~hit0 & ~hit2
    left = ~matched
    ask3 = left & (leaf[ids] == escape)
    known = c1[ids] - less > 0
    own = has_own.astype(np.int64)
    parts = [(ask0, cell(OWN, own, places2), hit0), (ask2, cell(TWO, own, places2), hit2), (ask1, cell(ONE, own, places1), hit1), (ask3, cell(KNOWN, own, np.zeros(len(ids), np.int64)), known)]
    return np.concatenate([doc[m] for m, _, _ in parts]), np.concatenate([c[m] for m, c, _ in parts]), np.concatenate([h[m] for m, _, h in parts]), left


def _added(parts: DataFrame) -> DataFrame:
    """chunk, data: the sum of float arrays by chunk, first over some of the tasks each, then over all."""

    def add(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in rows:
            for x in part.column("data"):
                x = np.frombuffer(x.as_py(), np.float64)
                total = x.copy() if total is None else total + x
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "data"])

    some = parts.withColumn("task", F.spark_partition_id() % 64).groupBy("chunk", "task").applyInArrow(add, "chunk long, data binary")
    return some.groupBy("chunk").applyInArrow(add, "chunk long, data binary")


def _chunks(first: int, x: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """The non-zero chunks of an array, numbered from ``first``."""
    full = [i for i in range(0, len(x), size) if x[i : i + size].any()]
    if full:
        yield pa.RecordBatch.from_arrays([pa.array([first + i // size for i in full], pa.int64()), pa.array([x[i : i + size].astype(np.float64).tobytes() for i in full], pa.binary())], names=["chunk", "data"])


def _code_counts(blocks: DataFrame, sent) -> np.ndarray:
    """Counts of the training tokens by kind and leaf."""
    leaves = len(sent.value.hashes) + 1
    per = -(-leaves // CHUNK)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, total = sent.value, np.zeros(KINDS * leaves)
        for batch in batches:
            for block in batch.to_pylist():
                toks, th, ids, length = _texts(block)
                train = ~np.repeat(np.array(block["held_out"], bool), length)
                kind = np.repeat(book.kind(block["top"], block["letter"]), length)
                total += np.bincount((kind * leaves + book.leaves(th)[ids])[train], minlength=KINDS * leaves)
        for k, x in enumerate(total.reshape(KINDS, leaves)):
            yield from _chunks(k * per, x, CHUNK)

    out = np.zeros((KINDS, leaves))
    main = blocks.select("tokens", "ids", "held_out", "length", "top", "letter")
    for r in _added(main.mapInArrow(count, "chunk long, data binary")).toLocalIterator():
        k, i = divmod(r["chunk"], per)
        x = np.frombuffer(r["data"], np.float64)
        out[k, i * CHUNK : i * CHUNK + len(x)] = x
    return out


def _decided(blocks: DataFrame, words: DataFrame, longer: DataFrame, sent, id_type: str) -> DataFrame:
    """For each document its counts, its base score, the score of its codes, the outcomes of its matches, and its spelled tokens."""
    schema = f"doc_id {id_type}, held_out boolean, n_bytes long, n_tokens long, n_known long, base double, coded double, cells binary, times binary, spelled binary"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        book, block = sent.value, left.to_pylist()[0]
        # a block's hashes are sorted, and so are the buckets
        right = sorted(zip(right.column("bucket").to_pylist(), right.column("totals").to_pylist()), key=lambda r: r[0])
        back = [np.concatenate([unpack(x[g], w).astype(np.int64) for _, x in right if len(x) == n]) for n, g, w in ((1, 0, 8), (2, 0, 4), (2, 1, 4))]
        toks, th, ids, length = _texts(block)
        first = np.cumsum(length) - length
        c1 = np.empty(len(toks), np.int64)
        c1[np.argsort(th)] = back[0]
        c2, c3 = (b[np.unique(h, return_inverse=True)[1]] for b, h in zip(back[1:], gram_hashes(th[ids], first)))
        del back
        train = ~np.array(block["held_out"], bool)
        kind, leaf = book.kind(block["top"], block["letter"]), book.leaves(th)
        base = np.log10((c1 + 0.5) / (book.total + 0.5 * (book.distinct + 1)))
        prior, escape = book.kinds.log_p(), len(book.hashes)
        out: list[list] = [[] for _ in range(6)]
        # some documents at a time, as the decisions need many times the room of the tokens
        group = first // SLICE_TOKENS
        for a, b in zip(cut := np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), [*cut[1:], len(length)]):
            own = slice(first[a], first[b] if b < len(length) else len(ids))
            t, n_docs, n = ids[own], b - a, length[a:b]
            owner, cell, hit, plain = decisions(th, t, n, train[a:b], kind[a:b], c1, c2[own], c3[own], leaf, escape)
            doc = np.repeat(np.arange(n_docs), n)
            coded = np.bincount(doc[plain], book.codes[kind[a:b][doc[plain]], leaf[t[plain]]], n_docs) + prior[kind[a:b]]
            escaped = plain & (leaf[t] == escape)
            times = c1[t] - train[a:b][doc]
            seen = escaped & (times > 0)
            coded += np.bincount(doc[seen], np.log(times[seen] / book.tail), n_docs)
            key, many = np.unique((owner << 32) | (cell * 2 + hit), return_counts=True)
            edge = np.searchsorted(key >> 32, np.arange(n_docs + 1))
            key, many = (key & 0xFFFFFFFF).astype(np.int32), many.astype(np.int32)
            new = np.flatnonzero(escaped & (times <= 0))
            ends = np.searchsorted(doc[new], np.arange(n_docs + 1))
            spelled = [b" ".join([toks[i] for i in t[new[x:y]]]) if y > x else None for x, y in zip(ends, ends[1:])]
            each = [np.bincount(doc, c1[t] > 0, n_docs).astype(np.int64).tolist(), np.bincount(doc, base[t], n_docs).tolist(), coded.tolist(), *([v[x:y].tobytes() for x, y in zip(edge, edge[1:])] for v in (key, many)), spelled]
            for o, e in zip(out, each):
                o += e
        columns = [left.column("doc_id").combine_chunks().flatten(), pa.array(block["held_out"], pa.bool_()), pa.array(block["n_bytes"], pa.int64()), pa.array(length, pa.int64()),
                   *(pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())))]
        return pa.Table.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    main = blocks.select("block", "tokens", "ids", "doc_id", "held_out", "n_bytes", "length", "top", "letter")
    back = words.filter("block IS NOT NULL").unionByName(longer).select(F.col("block").alias("to_block"), "bucket", "totals")
    return main.groupBy("block").cogroup(back.groupBy("to_block")).applyInArrow(lambda a, b: run(a, b), schema)


def _match_model(decided: DataFrame) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS * 2)
        for batch in batches:
            cell, n = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int32) for c in ("cells", "times"))
            total += np.bincount(cell, n, CELLS * 2)
        yield from _chunks(0, total, CHUNK)

    out = np.zeros(-(-CELLS * 2 // CHUNK) * CHUNK)
    for r in _added(decided.filter("NOT held_out").select("cells", "times").mapInArrow(count, "chunk long, data binary")).toLocalIterator():
        x = np.frombuffer(r["data"], np.float64)
        out[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(x)] = x
    out = out[: CELLS * 2].reshape(-1, 2)
    return match_log_p(out[:, 1], out[:, 0])


def _words(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[list[bytes]]:
    for batch in batches:
        toks = [t for x in batch.column("spelled").to_pylist() for t in x.split(b" ")]
        for at in range(0, len(toks), at_once):
            yield toks[at : at + at_once]


def _speller(decided: DataFrame, table_bits: int) -> Speller:
    """Learns to spell from the training tokens that no other place has: each is one of its own counts only."""
    spark = decided.sparkSession
    chunks = (2 << table_bits) // CHUNK
    words = decided.filter("NOT held_out AND spelled IS NOT NULL").select("spelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = np.zeros((len(ORDERS), 1 << table_bits, 2))
        for toks in _words(batches, 20_000):
            count_bits(toks, np.ones(len(toks)), into, table_bits)
        for p in range(len(ORDERS)):
            yield from _chunks(p * chunks, into[p].ravel(), CHUNK)

    tables = [np.zeros(2 << table_bits, np.float32) for _ in ORDERS]
    for r in _added(words.mapInArrow(count, "chunk long, data binary")).toLocalIterator():
        p, i = divmod(r["chunk"], chunks)
        tables[p][i * CHUNK : (i + 1) * CHUNK] = np.frombuffer(r["data"], np.float64)
    tables = [t.reshape(-1, 2) for t in tables]
    sent = spark.sparkContext.broadcast(tables)  # predictors x slots x 8 bytes, whatever the input

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, seen = Mixer.start(), 0
        for toks in _words(batches, 4000):
            spelling_step(mixer, sent.value, toks, table_bits)
            seen += len(toks)
        if seen:
            yield from _chunks(0, np.concatenate([mixer.weights.ravel() * seen, mixer.map_counts.ravel(), [seen]]), CHUNK)

    mixer, size = Mixer.start(), Mixer.start().weights.size
    flat = np.zeros(size + mixer.map_counts.size + 1)
    for r in _added(words.mapInArrow(train, "chunk long, data binary")).toLocalIterator():
        x = np.frombuffer(r["data"], np.float64)
        flat[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(x)] = x
    if flat[-1]:
        mixer.weights[:], mixer.map_counts[:] = (flat[:size] / flat[-1]).reshape(mixer.weights.shape), flat[size:-1].reshape(mixer.map_counts.shape)
    sent.unpersist()
    return Speller.of(tables, mixer, table_bits)


def score(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", table_bits: int = TABLE_BITS) -> DataFrame:
    """doc_id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte for each row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(24, max(0, int(np.ceil(np.log2(max(size / 4.5 / BUCKET_GRAMS, 1))))))
    blocks = written(_blocks(rows), "blocks")
    words = written(_totals(_sent(blocks, bits, False), False), "words")
    longer = _totals(_sent(blocks, bits, True), True)
    facts = words.filter("block IS NULL")
    sums = facts.agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("book").to_pylist(), batch.column("often").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.int64)), pa.array(np.frombuffer(b, np.int64))], names=["h", "n"])

    common = facts.select("book", "often").mapInArrow(listed, "h long, n long").orderBy(F.col("n").desc(), "h").limit(BOOK).collect()  # at most BOOK rows
    h, n = np.array([r["h"] for r in common], np.int64).view(np.uint64), np.array([r["n"] for r in common], np.int64)
    del common
    order = np.argsort(h)
    each = blocks.select(F.explode(F.arrays_zip("held_out", "top", "letter")).alias("d")).filter("NOT d.held_out").groupBy("d.top", "d.letter").count()
    listed_kinds = each.orderBy(F.col("count").desc(), "top", "letter").limit(KINDS - 1).collect()
    train_docs = each.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    times = np.zeros(KINDS)
    times[: len(listed_kinds)] = [r["count"] for r in listed_kinds]
    times[-1] = train_docs - times.sum()
    kinds = Kinds([(r["top"], r["letter"]) for r in listed_kinds], times)
    book = Book(h[order], order, kinds, int(sums[1]), int(sums[0]), float(max(sums[1] - n.sum(), 1)))
    counts = _code_counts(blocks, spark.sparkContext.broadcast(book))
    book.codes = code_log_p(counts, kinds).astype(np.float32)
    del counts
    decided = written(_decided(blocks, words, longer, spark.sparkContext.broadcast(book), dict(rows.dtypes)["doc_id"]), "decided")
    matches, speller = _match_model(decided), _speller(decided, table_bits)
    sent = spark.sparkContext.broadcast((matches.ravel(), speller))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matched, spell = sent.value
        for batch in batches:
            length = np.array([len(x) // 4 for x in batch.column("cells").to_pylist()])
            cell, n = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int32) for c in ("cells", "times"))
            log_p = batch.column("coded").to_numpy() + np.bincount(np.repeat(np.arange(len(length)), length), matched[cell] * n, len(length))
            toks, owner = [], []
            for i, x in enumerate(batch.column("spelled").to_pylist()):
                if x is not None:
                    toks += (t := x.split(b" "))
                    owner += [i] * len(t)
            for at in range(0, len(toks), 8000):
                log_p += np.bincount(owner[at : at + 8000], spell.log_p(toks[at : at + 8000]), len(length))
            names = ["doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "base"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(log_p / np.log(10))], names=[*names, "score"])

    schema = ", ".join(f"{c} {t}" for c, t in decided.dtypes if c in ("doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "base")) + ", score double"
    out = decided.mapInArrow(finish, schema)
    per_byte = -F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))
    return out.select("doc_id", "held_out", "n_bytes", "n_tokens", "n_known", F.lit(book.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", per_byte.alias("bits_per_byte"))
