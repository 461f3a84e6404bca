"""Token counts of a byte-level BPE vocabulary with a whole-token shortcut.

Before the job, every vocabulary string is run through the library once: those that come back as one
token are whole. In the job a text is split into pre-tokens; a whole one counts 1 without any merging, and
only the rest goes through the library's merges. The split is proved as well: code points on which it and the
library could differ are found by trying each, and a stretch of text that holds one is left to the library.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlark.llm.common import without

#: The split of byte-level BPE in terms of the standard library: letters, digits, others, white space.
PRE_TOKEN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_PROVED_TO = 0x10000
_CACHED = 1_000_000  # merged pre-tokens a worker remembers before it starts afresh


#: The visible character of every byte: printable Latin-1 stands for itself, the others follow from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_ALPHABET = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}


def as_bytes(part: str) -> str:
    """A pre-token in the byte alphabet of the merges."""
    return part.encode().decode("latin-1").translate(_ALPHABET)


@dataclass(frozen=True)
class Shortcut:
    """What was proved about a vocabulary file."""

    path: str
    whole: frozenset[str]
    special: tuple[str, ...]
    unsafe: str  # pattern of the code points that are left to the library


def prove(path: str) -> Shortcut:
    """Run the vocabulary and all code points of the basic plane through the library (about 3 s)."""
    library = Tokenizer.from_file(path)
    strings = [library.decoder.decode([library.id_to_token(i)]) for i in range(library.get_vocab_size(False))]
    encoded = library.encode_batch(strings, add_special_tokens=False)
    whole = frozenset(
        s for s, e in zip(strings, encoded) if len(e) == 1 and "�" not in s and PRE_TOKEN.findall(s) == [s]
    )
    unsafe = []
    for point in range(_PROVED_TO):
        if 0xD800 <= point < 0xE000:
            continue
        c = chr(point)
        trial = f"a{c}a1{c}1!{c}! {c} x{c}{c}"
        theirs = library.pre_tokenizer.pre_tokenize_str(trial)
        ours = PRE_TOKEN.findall(trial)
        if [trial[a:b] for _, (a, b) in theirs] != ours or [x for x, _ in theirs] != list(map(as_bytes, ours)):
            unsafe.append(c)
    added = library.get_added_tokens_decoder().values()
    special = tuple(sorted((t.content for t in added), key=len, reverse=True))
    plain = all(not (t.lstrip or t.rstrip or t.single_word) for t in added)
    if not plain or library.normalizer is not None:
        raise ValueError("the shortcut is proved for vocabularies without normalizer and with plain added tokens")
    pattern = "[" + "".join(map(re.escape, unsafe)) + re.escape(chr(_PROVED_TO)) + "-\U0010ffff]"
    return Shortcut(path, whole, special, pattern)


class Counter(dict):
    """Tokens of a pre-token: 1 for the whole ones; others are merged by the library once and remembered."""

    def __init__(self, proof: Shortcut):
        super().__init__(dict.fromkeys(proof.whole, 1))
        self.library = Tokenizer.from_file(proof.path)
        self.merge = self.library.model.tokenize
        self.whole = proof.whole
        self.cut = re.compile("|".join(map(re.escape, proof.special))) if proof.special else None
        self.unsafe = re.compile(proof.unsafe)

    def __missing__(self, part: str) -> int:
        if len(self) > len(self.whole) + _CACHED:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        self[part] = n = len(self.merge(as_bytes(part)))
        return n

    def count(self, text: str) -> int:
        """Special strings inside the text are one token each, which is the library's default."""
        if self.cut is None or self.cut.search(text) is None:
            return self._stretch(text)
        pieces = self.cut.split(text)
        return len(pieces) - 1 + sum(map(self._stretch, pieces))

    def _stretch(self, text: str) -> int:
        if not text.isascii() or not text.isprintable():
            if self.unsafe.search(text):
                return len(self.library.encode(text, add_special_tokens=False))
        return sum(map(self.__getitem__, PRE_TOKEN.findall(text)))


def n_tokens(text: Column, proof: Shortcut, spark) -> Column:
    """Token count of a text as a column; null counts as empty. Bounded memory: the vocabulary, one cache of
    pre-tokens and one text at a time."""
    shared = spark.sparkContext.broadcast(proof)  # as large as the vocabulary

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(shared.value)
        for texts in batches:
            yield pa.array((counter.count(t.as_py() or "") for t in texts), pa.int64())

    return of(text)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """The documents with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > ``limit``).

    Counts are those of the library on the whole text without begin, end or added special tokens. Null and
    empty texts have 0 of both. Every row returns a row.
    """
    docs = without(docs, "n_bytes", "n_tokens", "over_limit")
    counted = docs.withColumns({
        "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
        "n_tokens": n_tokens(F.col(text), prove(path), docs.sparkSession),
    })
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
