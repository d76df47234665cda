"""Runs (maximal periodic stretches) of words, found with a run-length grammar made by recompression.

A task joins the texts of a block to one string of word numbers, with a number of its own between two texts, and
compresses it by turns: in one round each block of equal letters becomes a letter, in the next the letters are split in
two classes and each pair of a first-class and a following second-class letter becomes one. Where a letter
of the next round begins depends on two neighbouring letters only, so equal stretches are cut alike, and the common
extension of two positions climbs the rounds while both positions are cut, and comes down again after the first
difference: a few steps a round, for all candidates of a block at once. Backwards it works the same way.

Candidates lie on a harmonic grid: for each period q, positions g = 0, q, 2q, ... whose word recurs at g + q, g + 2q and
g + 3q, which a run of four periods always has. Extensions of g and g + q to both sides give the run exactly. The
smallest period of a stretch is found first, since multiples of it give the same stretch. The work is n log n for n words,
and no suffix array is made.

Nothing is shuffled: each task reads its own split, so a lost executor costs only its splits. A block has about
``BLOCK_WORDS`` words or one text; memory is some 150 bytes a word of it, and candidates are extended ``AT_ONCE`` at a time.

Defined cases: null and empty texts have no words and no runs; repeated rows each get their rows; other columns are
ignored; an empty table gives an empty result; a run of any length is one run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import fold

BLOCK_WORDS, AT_ONCE = 200_000, 200_000
#: Fixed value: words are what lies between these characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A run has at least so many periods, and so many words.
PERIODS, LEAST = 4, 6


class Round:
    """One round's letters (with different ends that equal nothing), where the next round's letters begin, and how far blocks go."""

    def __init__(self, letters: np.ndarray, blocks: bool, seed: int):
        n = len(letters)
        self.padded = np.concatenate([[-2], letters, [-1]])
        same = letters[1:] == letters[:-1]
        if blocks:
            begins = np.concatenate([[True], ~same])
        else:
            mixed = (letters.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
            first = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63) == 0
            begins = np.concatenate([[True], ~(first[:-1] & ~first[1:])])
        self.starts = np.append(np.flatnonzero(begins), n).astype(np.int32)
        self.begins = np.append(begins, True)
        self.above = np.cumsum(self.begins, dtype=np.int32) - 1  # of a position where a letter begins: the next round's position
        # letters of the next round: the letter and length of a block, or both letters of a pair
        at, size = self.starts[:-1], np.diff(self.starts)
        second = size if blocks else np.where(size == 2, letters[np.minimum(at + 1, n - 1)] + 1, 0)
        key = letters[at].astype(np.int64) * (int(second.max(initial=0)) + 1) + second
        self.next = np.unique(key, return_inverse=True)[1].astype(np.int32)
        self.blocks = blocks
        if blocks:  # of a border: equal letters that follow it, and that come before it
            self.end = np.append(self.starts[1:][self.above[:-1]], n).astype(np.int32)
            self.start = np.concatenate([[0], self.starts[:-1][self.above[:-1]]]).astype(np.int32)


class Grammar:
    """Rounds of recompression over a string of numbers, and common extensions of pairs of its positions."""

    def __init__(self, letters: np.ndarray):
        self.rounds: list[Round] = []
        n = letters.astype(np.int32)
        while len(n) > 1:
            self.rounds.append(Round(n, len(self.rounds) % 2 == 0, len(self.rounds)))
            n = self.rounds[-1].next

    def extension(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many letters from positions i and j on (before them, if ``back``) are equal; i and j differ."""
        i, j = i.astype(np.int32), j.astype(np.int32)
        x, y = i.copy(), j.copy()
        stopped = np.full(len(x), -1)
        going = np.arange(len(x))
        step = -1 if back else 1
        for level, r in enumerate(self.rounds):
            here = going
            climbed = []
            while len(here):
                a, b = x[here], y[here]
                equal = r.padded[a + (not back)] == r.padded[b + (not back)]
                stopped[here[~equal]] = level
                here, a, b = here[equal], a[equal], b[equal]
                cut = r.begins[a] & r.begins[b]
                climbed.append(here[cut])
                here, a, b = here[~cut], a[~cut], b[~cut]
                by = self.stride(r, a, b, back) if r.blocks else 1
                x[here], y[here] = a + step * by, b + step * by
            going = np.concatenate(climbed) if climbed else here
            x[going], y[going] = r.above[x[going]], r.above[y[going]]
        for level in range(len(self.rounds) - 1, -1, -1):
            r = self.rounds[level]
            if level + 1 < len(self.rounds):
                here = np.flatnonzero(stopped > level)  # they stand on this round's borders now
                a, b = r.starts[x[here]], r.starts[y[here]]
                equal = r.padded[a + (not back)] == r.padded[b + (not back)]
                by = (self.stride(r, a, b, back) if r.blocks else 1) * equal
                x[here], y[here] = a + step * by, b + step * by
        return np.abs(x - i)

    @staticmethod
    def stride(r: Round, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
        """Equal letters from both borders on, within both blocks."""
        return np.minimum(a - r.start[a], b - r.start[b]) if back else np.minimum(r.end[a] - a, r.end[b] - b)


def grid(letters: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and periods up to ``most``, by rising period, whose word recurs after one, two and three periods."""
    n, q = len(letters), 1
    most = min(most, (n - 1) // (PERIODS - 1))
    while q <= most:
        # as many periods at once as make about AT_ONCE positions
        qs = np.arange(q, min(most, q + max(0, AT_ONCE * q // n)) + 1)
        counts = (n - 1 - (PERIODS - 1) * qs) // qs + 1
        period = np.repeat(qs, counts)
        at = (np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)) * period
        for k in range(1, PERIODS):
            same = letters[at] == letters[at + k * period]
            at, period = at[same], period[same]
        for k in range(0, len(at), AT_ONCE):
            yield at[k : k + AT_ONCE], period[k : k + AT_ONCE]
        q = int(qs[-1]) + 1


def runs(letters: np.ndarray, most: int | None = None) -> np.ndarray:
    """start, length and smallest period of every run, by start, then period; periods up to ``most``."""
    found, grammar = [np.empty((0, 3), np.int64)], None
    for at, period in grid(letters, len(letters) // PERIODS if most is None else most):
        if not len(at):
            continue
        if grammar is None:
            grammar = Grammar(np.unique(letters, return_inverse=True)[1])
        start = at - grammar.extension(at, at + period, back=True)
        own = start > at - period  # the first grid position of its run
        at, period, start = at[own], period[own], start[own]
        end = at + period + grammar.extension(at, at + period)
        good = end - start >= np.maximum(LEAST, PERIODS * period)
        found.append(np.stack([start[good], (end - start)[good], period[good]], 1).astype(np.int64))
    all_ = np.concatenate(found)
    order = np.lexsort((all_[:, 2], all_[:, 1], all_[:, 0]))
    all_ = all_[order]
    # the same stretch with a multiple of its period
    again = np.concatenate([[False], (all_[1:, :2] == all_[:-1, :2]).all(1)]) if len(all_) else np.empty(0, bool)
    all_ = all_[~again]
    return all_[np.lexsort((all_[:, 2], all_[:, 0]))]


def collapsed(words: list[str], own: np.ndarray) -> str:
    """The words that no run contains after its first period."""
    if not len(own):
        return " ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, own[:, 0] + own[:, 2], 1)
    np.add.at(change, own[:, 0] + own[:, 1], -1)
    return " ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (array of start, length and period, by start, then period) and the collapsed text of each row."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def block(rows: pa.Array, words: list[list[str]]) -> pa.RecordBatch:
        number: dict[str, int] = {}
        sizes = np.array([len(w) for w in words])
        at = np.concatenate([[0], np.cumsum(sizes + 1)])
        letters = np.empty(at[-1], np.int64)
        for k, own in enumerate(words):
            letters[at[k] : at[k] + len(own)] = [number.setdefault(w, len(number)) for w in own]
        letters[at[1:] - 1] = len(number) + np.arange(len(words))
        got = runs(letters, int(sizes.max()) // PERIODS)
        text = np.searchsorted(at, got[:, 0], "right") - 1
        bounds = np.searchsorted(text, np.arange(len(words) + 1))
        got[:, 0] -= at[text]
        fields = [pa.array(got[:, k], pa.int64()) for k in range(3)]
        structs = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
        texts = [collapsed(w, got[bounds[k] : bounds[k + 1]]) for k, w in enumerate(words)]
        return pa.RecordBatch.from_arrays([rows, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs), pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # texts of like length share a block, so that long periods are only looked for in long texts
            order = np.argsort(batch.column(1).to_pandas().str.len().to_numpy(), kind="stable")
            words: list[list[str]] = []
            rows: list[int] = []
            total = 0
            for k in order.tolist():
                own = WORD.findall(batch.column(1)[k].as_py())
                if words and (total + len(own) > BLOCK_WORDS or len(own) > 2 * len(words[0]) + 50):
                    yield block(batch.column(0).take(pa.array(rows)), words)
                    words, rows, total = [], [], 0
                words.append(own)
                rows.append(k)
                total += len(own)
            if rows:
                yield block(batch.column(0).take(pa.array(rows)), words)

    return slim.mapInArrow(task, f"doc_id {dict(slim.dtypes)['doc_id']}, runs array<struct<start long, length long, period long>>, collapsed string")


def planted(doc_id: str, text: Column) -> Column:
    """The text of a tenth of the ids, made periodic from some word on; null for the others and for texts without words.

    With h the crc32 of the decimal id, g = h div 10 and n words: if h mod 10 is 0, each word i >= a becomes the word
    a + (i - a) mod p, where a = g mod n and p = 1 + (n - a) div (3 + g mod 8).
    """
    h = fold(doc_id, 2**32)
    # the words are only taken apart where the fold is right
    words = F.regexp_extract_all(F.when(h % 10 == 0, text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g = F.floor(h / 10).cast("long")

    def made(s: Column) -> Column:
        w, n = s["w"], F.size(s["w"])
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        rest = F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(w, a + i % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, a), rest), " "))

    one = F.transform(F.array(F.struct(words.alias("w"))), made)  # the words are looked at once
    return F.get(one, 0)


def digest(found: DataFrame) -> DataFrame:
    """A row for each text: the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    best = F.get(F.sort_array(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"], r["length"].alias("length")))), 0)
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    rows = found.withColumn("__best", best)
    length, period = F.col("__best.length"), F.col("__best.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("__best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
