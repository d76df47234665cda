"""Logistic mixing of bit predictors, and a model that spells tokens bit by bit.

A mixer adds the stretched odds of several predictors with weights from the set that a gate selects; it learns online,
by gradient steps over batches of events. An adaptive map refines the mixed probability by what followed such
predictions in the same set.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Slots of each predictor's table, as a power of two.
TABLE_BITS = 20
CHUNK = 1 << 12
ORDERS = (1, 2, 3, 4, 6, 0)  # bytes of context; 0: the whole word so far
SETS, BUCKETS, LIMIT = 96, 33, 8.0
END = b"\n"
PRIOR = 0.4
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xBF58476D1CE4E5B9)]


def stretched(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The logarithm of the odds of a one."""
    return np.clip(np.log((ones + PRIOR) / (zeros + PRIOR)), -LIMIT, LIMIT).astype(np.float32)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Mixer:
    """Weights (sets x inputs), the adaptive map's counts of zeros and ones by set and stretched prediction, step sizes."""

    weights: np.ndarray
    map_counts: np.ndarray
    square: np.ndarray

    @classmethod
    def start(cls, sets: int = SETS, inputs: int = len(ORDERS)) -> Mixer:
        return cls(np.full((sets, inputs), 1.8 / inputs), np.zeros((sets, BUCKETS, 2)), np.full((sets, inputs), 1e-3))

    def predict(self, inputs: list[np.ndarray], sets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sets), np.float32)
        for w, x in zip(self.weights.T.astype(np.float32), inputs):
            out += w[sets] * x
        return np.clip(out, -LIMIT, LIMIT)

    def learn(self, inputs: list[np.ndarray], sets: np.ndarray, y: np.ndarray, weight: np.ndarray, mixed: np.ndarray) -> None:
        """One step on a batch of events, whose predictions are ``mixed``."""
        n = len(self.weights)
        bucket = np.rint((mixed + LIMIT) * ((BUCKETS - 1) / (2 * LIMIT))).astype(np.int64)
        self.map_counts += np.bincount((sets * BUCKETS + bucket) * 2 + y, weight, n * BUCKETS * 2).reshape(n, BUCKETS, 2)
        error = (y - squash(mixed)) * weight
        mass = np.maximum(np.bincount(sets, weight, n), 1e-9)
        for p, x in enumerate(inputs):
            grad = np.bincount(sets, error * x, n) / mass
            self.square[:, p] += grad * grad
            self.weights[:, p] += 0.05 * grad / np.sqrt(self.square[:, p])

    def table(self) -> np.ndarray:
        """The map's probability of a one, by set and bucket."""
        centre, n = squash(np.linspace(-LIMIT, LIMIT, BUCKETS)), self.map_counts
        return ((n[:, :, 1] + 20 * centre) / (n.sum(2) + 20)).astype(np.float32).ravel()

    @staticmethod
    def refined(mixed: np.ndarray, sets: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Probability of a one: a quarter the mixer's, three quarters the map's, between its two nearest buckets."""
        x = (mixed + np.float32(LIMIT)) * np.float32((BUCKETS - 1) / (2 * LIMIT))
        low = np.minimum(x.astype(np.int64), BUCKETS - 2)
        part, at = x - low.astype(np.float32), sets * BUCKETS + low
        return np.float32(0.25) * squash(mixed) + np.float32(0.75) * (table[at] * (1 - part) + table[at + 1] * part)


def learn_events(inputs: list[np.ndarray], sets: np.ndarray, n_sets: int, y: np.ndarray, weight: np.ndarray, passes: int = 2, batch: int = 1 << 14) -> Mixer:
    """A mixer after ``passes`` over weighted events in a fixed shuffled order; the map counts the last pass only."""
    mixer = Mixer.start(n_sets, len(inputs))
    order = np.random.RandomState(1).permutation(len(y))
    for _ in range(passes):
        mixer.map_counts[:] = 0
        for at in range(0, len(order), batch):
            i = order[at : at + batch]
            x = [v[i] for v in inputs]
            mixer.learn(x, sets[i], y[i], weight[i], mixer.predict(x, sets[i]))
    return mixer


# spelling ---------------------------------------------------------------------------------------------------------


class Coded:
    """The bytes of some tokens one after the other, with the hashes of each byte's contexts."""

    def __init__(self, toks: list[bytes]):
        coded = [t if t == END else t + b" " for t in toks]
        self.bytes = np.frombuffer(b"".join(coded), np.uint8)
        length = np.fromiter(map(len, coded), np.int64, len(coded))
        self.start = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(coded)), length)
        within = np.arange(len(self.bytes)) - self.start[self.owner]
        b = self.bytes.astype(np.uint64) + np.uint64(1)
        self.hashes = []
        h = np.zeros(len(b), np.uint64)
        for k in range(1, 7):
            prev = np.zeros(len(b), np.uint64)
            prev[k:] = b[:-k] if k < len(b) else 0
            prev[within < k] = 0
            h = h + prev * _MIX[k - 1]
            if k in ORDERS:
                self.hashes.append(h.copy())
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate([[1], np.full(int(length.max(initial=1)), _MIX[6])]).astype(np.uint64))
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * power[within])])
        self.hashes.append(run[:-1] - run[self.start][self.owner])
        self.hashes = [(h ^ (h >> np.uint64(32))) * _MIX[4] for h in self.hashes]
        self.hashes = [h ^ (h >> np.uint64(29)) for h in self.hashes]

    def slots(self, bit: int, predictor: int, table_bits: int) -> np.ndarray:
        node = (np.uint64(1 << bit) | (self.bytes >> np.uint8(8 - bit) if bit else np.uint8(0)).astype(np.uint64)) * _MIX[5]
        return (((self.hashes[predictor] + node) * _MIX[0]) >> np.uint64(64 - table_bits)).astype(np.int64)

    def bit(self, bit: int) -> np.ndarray:
        return (self.bytes >> np.uint8(7 - bit)) & np.uint8(1)


def count_bits(toks: list[bytes], counts: np.ndarray, into: np.ndarray, table_bits: int = TABLE_BITS) -> None:
    """Adds the tokens' bits, as often as they occur, to ``into``: predictors x slots x 2."""
    c = Coded(toks)
    weight = np.tile(counts[c.owner].astype(np.float64), 8)
    for p in range(len(ORDERS)):
        at = np.concatenate([2 * c.slots(bit, p, table_bits) + c.bit(bit) for bit in range(8)])
        into[p] += np.bincount(at, weight, 2 << table_bits).reshape(-1, 2)


def _gate(bit: int, seen_word: np.ndarray, seen_three: np.ndarray) -> np.ndarray:
    """The set of weights: by bit, by what the word so far has seen (4 steps), and the last three bytes (3 steps)."""
    return (bit * 4 + np.searchsorted([1, 3, 16], seen_word, "right")) * 3 + np.searchsorted([1, 9], seen_three, "right")


def spelling_step(mixer: Mixer, tables: list[np.ndarray], toks: list[bytes], table_bits: int) -> None:
    """An online step over tokens; each is left out of the tables once."""
    c, rows = Coded(toks), np.arange(len(toks) and len(b"".join(toks)) + sum(t != END for t in toks))
    weight = np.ones(len(rows))
    for bit in range(8):
        y = c.bit(bit).astype(np.int64)
        inputs, seen = [], []
        for p in range(len(ORDERS)):
            n = tables[p][c.slots(bit, p, table_bits)]
            n[rows, y] = np.maximum(n[rows, y] - 1, 0)
            inputs.append(stretched(n[:, 1], n[:, 0]))
            seen.append(n[:, 0] + n[:, 1])
        sets = _gate(bit, seen[5], seen[2])
        mixer.learn(inputs, sets, y, weight, mixer.predict(inputs, sets))


@dataclass
class Speller:
    stretched: list[np.ndarray]  # for each predictor, by slot, float32
    seen: list[np.ndarray]  # by slot, uint8: counts of the word so far and of three bytes, up to 255, for the gate
    mixer: Mixer
    table_bits: int

    @classmethod
    def of(cls, tables: list[np.ndarray], mixer: Mixer, table_bits: int) -> Speller:
        return cls([stretched(t[:, 1], t[:, 0]) for t in tables], [np.minimum(tables[p].sum(1), 255).astype(np.uint8) for p in (5, 2)], mixer, table_bits)

    def log_p(self, toks: list[bytes]) -> np.ndarray:
        """Natural logarithm of each token's probability."""
        c = Coded(toks)
        out, table = np.zeros(len(toks)), self.mixer.table()
        for bit in range(8):
            slots = [c.slots(bit, p, self.table_bits) for p in range(len(ORDERS))]
            x = [t[s] for t, s in zip(self.stretched, slots)]
            sets = _gate(bit, self.seen[0][slots[5]], self.seen[1][slots[2]])
            p1 = Mixer.refined(self.mixer.predict(x, sets), sets, table)
            out += np.bincount(c.owner, np.log(np.where(c.bit(bit) == 1, p1, 1 - p1)), len(toks))
        return out
