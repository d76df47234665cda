"""Token counts by byte-level BPE: pieces are counted once for each distinct pre-token of a task, joined to the
documents' pre-token frequencies and summed; no token ids are kept.

Each task reads its own split of the texts, so nothing is shuffled and a lost executor costs only its splits. The
dictionary of a task is emptied beyond ``MAX_PIECES`` entries, which bounds its memory and changes no result.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows each get their own row; columns besides
the two that are read are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the dictionary of pieces that a task keeps at most.
MAX_PIECES = 1_000_000

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PieceCounter:
    """Counts the tokens of texts with the vocabulary in ``path`` (a tokenizers .json file)."""

    def __init__(self, path: str, max_pieces: int = MAX_PIECES):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") is not None or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("only byte-level BPE without a normalizer is supported")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pre_token = regex.compile(PRE_TOKEN)
        self.pieces: dict[str, int] = {}
        self.max_pieces = max_pieces

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """The text's pre-tokens with their frequencies, and how many added tokens it spells out."""
        if self.special is None or not self.special.search(text):
            return Counter(self.pre_token.findall(text)), 0
        parts, found = self.special.split(text), Counter()
        for part in parts:
            found.update(self.pre_token.findall(part))
        return found, len(parts) - 1

    def counts(self, texts: list[str]) -> list[int]:
        freqs = [self.frequencies(t) for t in texts]
        if len(self.pieces) > self.max_pieces:
            self.pieces.clear()
        new = list({p for f, _ in freqs for p in f if p not in self.pieces})
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.pieces.update(zip(part, map(len, self.tokenizer.encode_batch(part, add_special_tokens=False))))
        known = self.pieces.__getitem__
        return [extra + sum(map(mul, map(known, f), f.values())) for f, extra in freqs]


def count_tokens(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; ``vocabulary`` is a file that every executor can open."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"doc_id {dict(slim.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                n = counter.counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return slim.mapInArrow(run, schema)
