"""Token counts of a byte-level BPE vocabulary, with a whole-token shortcut.

Before any text is read, every vocabulary string is run through the merges by
itself: those that come out as one token are proven whole. A pre-token among
them counts one without merging; only the rest is merged, and remembered. The
counts are those of the vocabulary's own library (no begin, end or added
special tokens; special strings inside a text are found first and count one
token each, which is that library's default).

The vocabulary file is read on the driver and broadcast (its size is that of
the file, not of the data), so executors need no file of their own.

Defined results: a null text counts as empty (0 bytes, 0 tokens); the id is
carried as it came; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import row_id

#: Fixed value: how the byte-level pre-tokeniser cuts text.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens that a worker remembers at most before it starts anew, and their length.
REMEMBERED, REMEMBERED_CHARS = 1 << 20, 128
_LONG_TEXT, _RUN = 1 << 20, 1 << 16


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary: itself
    where it prints, the next free letter from 256 on where it doesn't."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WholeTokenCounter:
    """Counts the tokens of texts; made from the text of a vocabulary file."""

    def __init__(self, vocabulary: str, whole: set[str] | None = None):
        held = json.loads(vocabulary)
        shape = (held.get("pre_tokenizer") or {}).get("type"), held["model"]["type"], held.get("normalizer"), (held.get("pre_tokenizer") or {}).get("add_prefix_space")
        if shape != ("ByteLevel", "BPE", None, False):
            raise ValueError(f"a byte-level BPE vocabulary without prefix space is needed, not {shape}")
        self.library = Tokenizer.from_str(vocabulary)
        self.model = self.library.model
        self.letters = byte_letters()
        bytes_of = {c: b for b, c in self.letters.items()}
        special = [t["content"] for t in held["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in held["added_tokens"]):
            raise ValueError("added tokens that strip or need word ends are not supported")
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cut = regex.compile(PRE_TOKEN)
        self.whole = set() if whole is None else whole
        for string in held["model"]["vocab"] if whole is None else ():
            if all(c in bytes_of for c in string) and len(self.model.tokenize(string)) == 1:
                try:
                    self.whole.add(bytes(bytes_of[c] for c in string).decode())
                except UnicodeDecodeError:
                    pass  # a part of a character is never a pre-token
        self.known: dict[str, int] = {}

    def _merged(self, pre_token: str) -> int:
        n = len(self.model.tokenize(pre_token.encode().decode("latin-1").translate(self.letters)))
        if len(pre_token) <= REMEMBERED_CHARS:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[pre_token] = n
        return n

    def _sum(self, pre_tokens: Counter) -> int:
        total, whole, known = 0, self.whole, self.known
        for t, k in pre_tokens.items():
            total += k if t in whole else k * (known.get(t) or self._merged(t))
        return total

    def count(self, text: str) -> int:
        total, parts = 0, [text]
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            total += len(parts) - 1
        for part in parts:
            if len(part) <= _LONG_TEXT:
                total += self._sum(Counter(self.cut.findall(part)))
            else:  # no list of a very long text's pre-tokens is ever held
                found = (m.group() for m in self.cut.finditer(part))
                while run := Counter(islice(found, _RUN)):
                    total += self._sum(run)
        return total


def _counted(vocabulary: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WholeTokenCounter(*vocabulary.value)
        for batch in batches:
            counts = [counter.count(x.as_py()) if x.is_valid else 0 for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row per input row; vocabulary: path of the file."""
    with open(vocabulary, encoding="utf-8") as f:
        held = f.read()
    # the proof is made once; tasks get the strings that it found
    shared = docs.sparkSession.sparkContext.broadcast((held, WholeTokenCounter(held).whole))
    rows = docs.select(row_id(key).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text).cast("long"), F.lit(0)).alias("n_bytes"))
    return rows.mapInArrow(_counted(shared), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
