"""Token counts by a whole-token shortcut.

Offline, every vocabulary string is merged by itself; those that end as a single token are proved
*whole*. A pre-token that equals a whole string counts one, by a set lookup and without merging;
only the others are merged. The counts are exactly the tokenizer's.

One narrow pass, no shuffle; a worker holds the proved set and a bounded memo of merged counts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import tidied

from recordloom.llm import bpe

#: Pre-tokens whose merged count a worker remembers; then it starts afresh.
MEMO = 1 << 19


class WholeTokenCounter:
    def __init__(self, path: str):
        self.bpe = bpe.load(path)
        self.whole = frozenset(self.prove())
        self.memo: dict[str, int] = {}

    def prove(self) -> Iterator[str]:
        """Vocabulary strings that are valid text and that merge to their own single token."""
        of_char = {c: b for b, c in enumerate(bpe.byte_alphabet())}
        for string, token in self.bpe.vocab.items():
            if string in self.bpe.added or any(c not in of_char for c in string):
                continue
            try:
                text = bytes(of_char[c] for c in string).decode("utf-8")
            except UnicodeDecodeError:
                continue  # part of a character; no pre-token equals it
            if self.bpe.merge(text) == [token]:
                yield text

    def merged(self, piece: str) -> int:
        n = len(self.bpe.merge(piece))
        if len(piece) <= bpe.MEMO_LENGTH:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[piece] = n
        return n

    def count(self, text: str) -> int:
        total = 0
        for part, special in self.bpe.parts(text):
            if special:
                total += 1
                continue
            pieces = self.bpe.pattern(part).findall(part)
            rest = [p for p in pieces if p not in self.whole]
            total += len(pieces) - len(rest)
            for p, n in zip(rest, map(self.memo.get, rest)):
                total += n or self.merged(p)
        return total


@functools.lru_cache(maxsize=4)
def counter(path: str) -> WholeTokenCounter:
    return WholeTokenCounter(path)


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", output: str = "n_tokens") -> DataFrame:
    """``docs`` with a long column ``output``: the tokens of each whole text.

    ``tokenizer`` is the path of a byte-level BPE file. Special strings inside a text count as one
    token each, as the library's default has it. Null and empty texts have 0 tokens; repeated rows
    are counted each; other columns pass through, but one named ``output`` is replaced; an empty
    table gives an empty table.
    """

    @F.arrow_udf("long")
    @tidied
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = counter(tokenizer)
        for batch in batches:
            yield pa.array([tokens.count(t.as_py() or "") for t in batch], pa.int64())

    return docs.withColumn(output, count(F.coalesce(F.col(text), F.lit(""))))
