"""Token counts: each distinct pre-token is counted once by the library, documents add up frequencies times counts.

No token ids of a document are made. Every Python task keeps one table of pre-token -> number of pieces,
bounded by max_entries; it is emptied when full, so memory is bounded and results do not change.
Nothing is shuffled: the text stays in the task that reads it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from operator import mul

import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, slices, spread, table, texts

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
MAX_ENTRIES = 400_000

#: The published split pattern of byte-level BPE vocabularies (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts with such characters are split by the library itself: Unicode tables of the two regex engines can differ there.
UNSURE = regex.compile(r"[\x1c-\x1f\x85\p{Cn}\p{Co}]|[^\u0000-\uffff]")
#: Below this code point the split pattern is spelled out with plain character classes, which the re module runs faster.
PLAIN_END = 0x250
BEYOND = re.compile(f"[\x1c-\x1f\x85{chr(PLAIN_END)}-\U0010ffff]")


def plain_split() -> re.Pattern:
    """SPLIT for texts of characters below PLAIN_END."""
    kinds = {"L": "", "N": "", "Z": ""}
    for c in map(chr, range(PLAIN_END)):
        kind = "Z" if c.isspace() else unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind] += re.escape(c)
    space = kinds["Z"]
    named = SPLIT.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{kinds['L']}{kinds['N']}]").replace(r"\p{L}", f"[{kinds['L']}]").replace(r"\p{N}", f"[{kinds['N']}]")
    return re.compile(named.replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]"))


def byte_letters() -> dict[int, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class PretokenCounter:
    """Pieces of a text by adding up its pre-tokens' pieces."""

    def __init__(self, path: str, max_entries: int = MAX_ENTRIES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} isn't a plain byte-level vocabulary")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.find, self.find_plain = regex.compile(SPLIT).findall, plain_split().findall
        self.letters = byte_letters()
        self.max_entries = max_entries
        self.bytes = {chr(c): b for b, c in self.letters.items()}
        self.pieces: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        """The library's own pre-tokens. Bytes that are no character of their own stay apart."""
        raw = [bytes(map(self.bytes.__getitem__, said)) for said, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return [r.decode("utf-8", "surrogateescape") for r in raw]

    def _fill(self, new: list[str]) -> None:
        tokenize, letters = self.library.model.tokenize, self.letters
        for w in new:
            self.pieces[w] = len(tokenize(w.encode("utf-8", "surrogateescape").decode("latin-1").translate(letters)))

    def count(self, text: str) -> int:
        find = self.find_plain
        if BEYOND.search(text):
            find = self.split if UNSURE.search(text) else self.find
        parts = self.special.split(text) if self.special else [text]
        total, pieces = len(parts) - 1, self.pieces
        for part in parts:
            freq = Counter(find(part))
            new = [w for w in freq if w not in pieces]
            if new:
                if len(pieces) + len(new) > self.max_entries:
                    pieces.clear()
                    new = freq.keys()
                self._fill(new)
            total += sum(map(mul, map(pieces.__getitem__, freq), freq.values()))
        return total


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs.

    A null or empty text has no bytes and no tokens. Repeated rows and ids each give their own row; a null id stays
    null. Other columns of docs are ignored, whatever their names. An empty table gives an empty table. Long texts are
    counted whole, in the task that reads them. There are no ties.
    """

    def run(batches):
        counter = PretokenCounter(path, max_entries)
        for b in slices(batches, "text"):
            rows = [t or "" for t in b.column("text").to_pylist()]
            n = [counter.count(t) for t in rows]
            yield {"doc_id": b.column("doc_id"), "n_bytes": [len(t.encode()) for t in rows], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_arrow(texts(docs), run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spread(table(spark, sf_dir, "documents")), public_tokenizers.path(TOKENIZER))


ORACLE_SQL = None  # merges of a vocabulary can't be said in SQL
