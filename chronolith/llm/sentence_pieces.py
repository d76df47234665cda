"""Encoding and decoding with a BPE piece model (a sentencepiece .model file), exactly as its library does.

The encoder never merges. For each prefix of a stretch of text exactly one piece is the last of the prefix's encoding;
a table keeps it. An automaton gives the pieces that end at a position, and of those the one belongs into the table
that is compatible with the last piece of the prefix before it: two pieces are compatible if merging their
characters side by side never joins across the border. The ids are then read off the table from the end backwards.

Why this is exact: the merges inside of two neighbouring pieces are made by score, then from left to right, whatever
lies around them. So no merge crosses any border of a sequence of pieces if none crosses the border of any two
neighbours; and that sequence is the only one the merges can give. It holds for any scores, ties included.

Texts are cut where two neighbouring characters are side by side in no piece, as before a space mark that follows a letter;
no merge crosses such a place. A task encodes each distinct stretch once, short ones together, and keeps their ids. The
memory of a task is bounded in bytes: ``CACHE_BYTES`` for stretches, ``CACHE_PAIRS`` for tested pairs (both are emptied
when full, which changes no result), and some 100 bytes a character for a block of texts.

Nothing is shuffled: each task reads its own split, so a lost executor costs only its splits.

Defined cases: a null text counts as empty (the end id alone, if asked for); repeated rows each get their own row; other
columns are ignored; an empty table gives an empty result; null ids, and arrays with null elements, decode like the
ids without the nulls; an id outside of the vocabulary is an error, as in the library.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_BYTES, CACHE_PAIRS = 32 << 20, 500_000
#: Stretches of more characters have a table of their own; the others are encoded together.
LONG = 64
#: Characters of text that become rows of one batch.
BATCH_CHARS = 512 << 10

#: Fixed value: the mark that stands for a space.
MARK = "▁"
#: Ends texts that are encoded together; no text can have it.
BORDER = "\ud800"
#: Types of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

NEVER = float("-inf")


class Vocabulary:
    """Pieces of a model file, and the decoding of their ids."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if model.trainer_spec.model_type != model.trainer_spec.BPE or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE} or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback and without user-defined pieces are supported")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep texts as they are, but for space marks, are supported")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.pieces = [(p.piece, p.type) for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.end_id = next(i for i, p in enumerate(model.pieces) if p.piece == model.trainer_spec.eos_piece)
        self.unknown_surface = model.trainer_spec.unk_surface

    def surfaces(self) -> list[bytes]:
        """What each id adds to a text: bytes for byte pieces, nothing for control pieces."""
        made = {CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[1:-1], 16)]), UNKNOWN: lambda p: self.unknown_surface.encode(), NORMAL: lambda p: p.replace(MARK, " ").encode()}
        return [made[kind](p) for p, kind in self.pieces]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes next to each other make characters, invalid ones the replacement character each."""
        out, run, start = [], bytearray(), True

        def flush() -> None:
            at = 0
            while at < len(run):
                size = next((n for n in range(1, 5) if is_character(run[at : at + n])), 0)
                out.append(run[at : at + size].decode() if size else "�")
                at += size or 1
            run.clear()

        for i in ids:
            if not 0 <= i < len(self.pieces):
                raise IndexError(f"id {i} is outside of the vocabulary")
            piece, kind = self.pieces[i]
            if kind == BYTE:
                run.append(int(piece[1:-1], 16))
                continue
            flush()
            start = start and not any(out)
            if kind == NORMAL:
                if start and self.prefix and piece.startswith(MARK):
                    piece, start = piece[1:], False
                out.append(piece.replace(MARK, " "))
            elif kind == UNKNOWN:
                out.append(self.unknown_surface)
        flush()
        return "".join(out)


class Encoder(Vocabulary):
    """Histories of the pieces' merges, an automaton over those that merges can give, and what was encoded before."""

    def __init__(self, path: str):
        import ahocorasick

        super().__init__(path)
        self.byte_ids = [0] * 256
        for i, (piece, kind) in enumerate(self.pieces):
            if kind == BYTE:
                self.byte_ids[int(piece[1:-1], 16)] = i
        # tokens are the pieces that merges give, and the characters that only longer pieces have
        self.alphabet = {c for p in self.ids for c in p}
        self.singles = self.alphabet & self.ids.keys()
        # characters that no piece has side by side are never joined: kinds of characters, and which may follow which
        beside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        kinds = {c: k for k, c in enumerate(sorted({c for pair in beside for c in pair}), 1)}
        self.kind = np.zeros(0x110000, np.uint16)
        self.kind[[ord(c) for c in kinds]] = list(kinds.values())
        self.joined = np.zeros((len(kinds) + 1, len(kinds) + 1), bool)
        for one, two in beside:
            self.joined[kinds[one], kinds[two]] = True
        self.histories: list[tuple[list[float], list[str], list[str]]] = []
        self.own_ids: list[list[int]] = []  # of each token, from its end
        self.sizes: list[int] = []
        self.automaton = ahocorasick.Automaton()
        for token in [*self.ids, *sorted(self.alphabet - self.ids.keys())]:
            history, left = self.merges(token)
            if left == [token]:
                self.automaton.add_word(token, len(self.sizes))
                self.histories.append(history)
                self.own_ids.append([self.ids[token]] if token in self.ids else [self.byte_ids[b] for b in reversed(token.encode())])
                self.sizes.append(len(token))
        self.automaton.make_automaton()
        self.size_of, self.id_of = np.array(self.sizes), np.array([i[0] for i in self.own_ids], np.int32)
        self.forget_pairs()
        self.forget()

    def forget_pairs(self) -> None:
        """Tested pairs by hash: a key (first token times the number of tokens, plus the second), and whether they fit."""
        self.pair_keys, self.pair_fits, self.n_pairs = np.full(4 * CACHE_PAIRS, -1), np.zeros(4 * CACHE_PAIRS, bool), 0
        self.pairs: dict[int, bool] = {}  # the same for long stretches

    def forget(self) -> None:
        """Ids of stretches, one behind the other, and where those of each stretch start; number 0 is the end of a text."""
        self.number = {BORDER: 0}
        self.flat, self.starts, self.kept_bytes = array("i", [self.end_id]), array("q", [0, 1]), 0

    def merges(self, text: str) -> tuple[tuple[list[float], list[str], list[str]], list[str]]:
        """Scores of the merges of a short text in order (none: never), its first and last symbol before each; and what is left."""
        now, heads, first, last = list(text), [], [], []
        while True:
            score, at = max(((self.scores.get(a + b, NEVER), -i) for i, (a, b) in enumerate(zip(now, now[1:]))), default=(NEVER, 0))
            heads.append(score)
            first.append(now[0])
            last.append(now[-1])
            if score == NEVER:
                return (heads, first, last), now
            now[-at : 2 - at] = [now[-at] + now[1 - at]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of two neighbouring pieces' characters never join across their border."""
        (heads_a, _, last), (heads_b, first, _) = self.histories[a], self.histories[b]
        i = j = 0
        while True:
            across = self.scores.get(last[i] + first[j], NEVER)
            if across > heads_a[i] and across >= heads_b[j]:  # of equal scores the leftmost comes first
                return False
            if heads_a[i] == heads_b[j] == NEVER:
                return True
            if heads_a[i] >= heads_b[j]:
                i += 1
            else:
                j += 1

    def fit(self, keys: np.ndarray) -> np.ndarray:
        """Whether pairs of tokens are compatible, by their keys."""
        out, todo = np.empty(len(keys), bool), np.arange(len(keys))
        slot = slots(keys, len(self.pair_keys))
        while len(todo):
            there = self.pair_keys[slot]
            found = there == keys[todo]
            out[todo[found]] = self.pair_fits[slot[found]]
            if (there[~found] < 0).any():  # new pairs
                new = np.unique(keys[todo[~found][there[~found] < 0]])
                if self.n_pairs + len(new) > CACHE_PAIRS:
                    self.forget_pairs()
                for key in new.tolist():
                    self.learn_pair(key)
                rest = todo[~found]
                out[rest] = self.fit(keys[rest])
                return out
            todo, slot = todo[~found], (slot[~found] + 1) % len(self.pair_keys)
        return out

    def learn_pair(self, key: int) -> None:
        at = slots(key, len(self.pair_keys))
        while self.pair_keys[at] >= 0:
            if self.pair_keys[at] == key:
                return
            at = (at + 1) % len(self.pair_keys)
        self.pair_keys[at], self.pair_fits[at] = key, self.compatible(*divmod(key, len(self.sizes)))
        self.n_pairs += 1

    def last_pieces(self, text: str) -> list[int]:
        """For each prefix of a text of the alphabet (from one character on) the last token of its encoding."""
        table: list[int] = []
        sizes, n, done, pairs = self.sizes, len(self.sizes), -1, self.pairs
        for end, token in self.automaton.iter(text):  # all tokens that end at a position, the longest first
            if end == done:
                continue
            if sizes[token] <= end:
                key = table[end - sizes[token]] * n + token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= CACHE_PAIRS:
                        pairs.clear()
                    fits = pairs[key] = self.compatible(*divmod(key, n))
                if not fits:
                    continue
            table.append(token)
            done = end
        return table

    def long_stretch(self, text: str) -> list[int]:
        """Ids of a stretch that is long, or has characters without a piece of their own."""
        out: list[int] = []
        for inside, part in groupby(text, self.alphabet.__contains__):  # what no piece has stays apart
            part = "".join(part)
            if not inside:
                out.extend(self.byte_ids[b] for b in part.encode())
                continue
            table, found, at = self.last_pieces(part), [], len(part) - 1
            while at >= 0:
                found += self.own_ids[table[at]]
                at -= self.sizes[table[at]]
            out.extend(reversed(found))
        return out

    def short_stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches of pieces' characters, and how many each has: all tables are filled a position at a time."""
        texts.sort()  # neighbours share their way through the automaton
        texts.sort(key=len, reverse=True)
        sizes = np.array([len(t) for t in texts])
        begin = np.cumsum(sizes + 1) - sizes - 1
        found = np.fromiter(chain.from_iterable(self.automaton.iter(BORDER.join(texts))), np.int64).reshape(-1, 2)
        token, many = found[:, 1], np.bincount(found[:, 0], minlength=int(begin[-1] + sizes[-1]))
        first, table, n = np.cumsum(many) - many, np.full(len(many), -1), len(self.sizes)
        for k in range(int(sizes[0])):
            at = begin[: np.searchsorted(-sizes, -k, "left")] + k
            match = first[at]
            while len(at):  # the tokens that end here, the longest first
                own = token[match]
                size = self.size_of[own]
                good = size > k
                inner = np.flatnonzero(~good)
                good[inner] = self.fit(table[at[inner] - size[inner]] * n + own[inner])
                table[at[good]] = own[good]
                at, match = at[~good], match[~good] + 1
        where, at, rounds = np.arange(len(texts)), begin + sizes - 1, []
        while len(where):  # tokens from the end backwards
            own = table[at]
            rounds.append((where, self.id_of[own]))
            at = at - self.size_of[own]
            more = at >= begin[where]
            where, at = where[more], at[more]
        counts = np.bincount(np.concatenate([w for w, _ in rounds]), minlength=len(texts))
        last, out = np.cumsum(counts) - 1, np.empty(int(counts.sum()), np.int32)
        for k, (w, i) in enumerate(rounds):
            out[last[w] - k] = i
        return out, counts

    def learn(self, new: list[str]) -> None:
        short = [t for t in new if len(t) <= LONG and self.singles.issuperset(t)]
        for k in range(0, len(short), 50_000):
            part = short[k : k + 50_000]
            ids, counts = self.short_stretches(part)
            self.number.update(zip(part, range(len(self.starts) - 1, len(self.starts) - 1 + len(part))))
            self.starts.frombytes((self.starts[-1] + np.cumsum(counts)).astype(np.int64).tobytes())
            self.flat.frombytes(ids.tobytes())
        for t in new:
            if t not in self.number:
                self.number[t] = len(self.starts) - 1
                self.flat.extend(self.long_stretch(t))
                self.starts.append(len(self.flat))
        self.kept_bytes += sum(200 + 8 * len(t) for t in new)  # key, entry and ids, counted generously

    def encode(self, texts: list[str], end: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one behind the other, and how many each text has; without begin, with an end id if ``end``."""
        if self.kept_bytes > CACHE_BYTES:
            self.forget()
        whole = "".join([f"{t and self.prefix + t}{BORDER}" for t in texts]).replace(" ", MARK)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[codes]
        cuts = np.concatenate([[0], np.flatnonzero(~self.joined[kind[:-1], kind[1:]]) + 1, [len(codes)]])
        places = cuts.tolist()
        parts = [whole[a:b] for a, b in zip(places, places[1:])]
        self.learn([p for p in set(parts) if p not in self.number])
        which = np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))
        starts = np.frombuffer(self.starts, np.int64)
        start, size = starts[which], np.where(which > 0, starts[which + 1] - starts[which], int(end))
        ends = np.cumsum(size)
        at = np.repeat(start - ends + size, size) + np.arange(size.sum())
        return np.frombuffer(self.flat, np.int32)[at], np.diff(ends[which == 0], prepend=0)


def slots(keys: np.ndarray | int, n: int) -> np.ndarray | int:
    return ((keys * 0x9E3779B97F4A7C1 & 2**62 - 1) >> 20) % n


@lru_cache(1)  # once for each Python worker
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def is_character(b: bytes) -> bool:
    try:
        return len(b.decode()) == 1
    except UnicodeDecodeError:
        return False


def pieces_of_text(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``BATCH_CHARS`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > BATCH_CHARS:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if len(sizes) > at:
        yield batch.slice(at)


def encoded(batches: Iterator[pa.RecordBatch], model: str, end: bool) -> Iterator[pa.RecordBatch]:
    """doc_id and ids of batches of doc_id and text."""
    pieces = encoder(model)
    for batch in batches:
        for part in pieces_of_text(batch, 1):
            ids, sizes = pieces.encode(part.column(1).to_pylist(), end)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])


def decoded(batches: Iterator[pa.RecordBatch], pieces: Vocabulary) -> Iterator[pa.RecordBatch]:
    """doc_id, ids and text of batches of doc_id and ids."""
    surfaces = pa.array(pieces.surfaces(), pa.binary())
    # rows whose first id is an ordinary piece with a mark and whose control ids are at the end are joined at once
    plain = pa.array([kind == NORMAL and p.startswith(MARK) and bool(pieces.prefix) for p, kind in pieces.pieces])
    control = pa.array([kind == CONTROL for _, kind in pieces.pieces])
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            lists = part.column(1)
            ids = lists.flatten()
            joined = pc.binary_join(pa.ListArray.from_arrays(lists.offsets.cast(pa.int32()), surfaces.take(lists.values)), b"")
            easy, inner, start = plain.take(ids).to_numpy(zero_copy_only=False), control.take(ids), 0
            texts = []
            for row, n in enumerate(pc.list_value_length(lists).to_pylist()):
                one = None
                if n > 1 and easy[start] and not pc.any(inner.slice(start, n - 1)).as_py():
                    try:
                        one = joined[row].as_py()[1:].decode()
                    except UnicodeDecodeError:
                        one = None
                texts.append(pieces.decode(ids.slice(start, n).to_pylist()) if one is None else one)
                start += n
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), dict(docs.dtypes)[id_col]


def encode(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """doc_id and ids (array<int>) of each row's text, with an end id if ``end``; ``model`` is a file that every executor can open."""
    slim, kind = _texts(docs, id_col, text_col)
    return slim.mapInArrow(lambda batches: encoded(batches, model, end), f"doc_id {kind}, ids array<int>")


def decode(ids: DataFrame, model: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids and text of each row's ids."""
    slim = ids.select(F.col(id_col).alias("doc_id"), F.array_compact(F.coalesce(F.col(ids_col), F.array().cast("array<int>"))).cast("array<int>").alias("ids"))
    return slim.mapInArrow(lambda batches: decoded(batches, vocabulary(model)), f"doc_id {dict(slim.dtypes)['doc_id']}, ids array<int>, text string")


def round_trip(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """doc_id, ids and the text that the ids give: ``decode`` of ``encode``, both in one worker."""
    slim, kind = _texts(docs, id_col, text_col)
    return slim.mapInArrow(lambda batches: decoded(encoded(batches, model, end), encoder(model)), f"doc_id {kind}, ids array<int>, text string")


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
