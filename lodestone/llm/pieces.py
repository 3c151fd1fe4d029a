"""SentencePiece encoding and decoding through a table of distinct marked words.

Where no piece of a BPE model has a whitespace marker after another character, merges never cross from a word
into the next marker. A text then falls into chunks (a run of markers and the word after it) whose segmentations
do not depend on each other: each distinct chunk is segmented once, and the documents' ids are joined back by
position. Every Python task keeps one such table, bounded by max_entries and emptied when full. Nothing is
shuffled. Models that break the condition are refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, slices, spread, table, texts

MODEL = "piece_bpe_32k.model"
MARK = "▁"
MAX_ENTRIES = 200_000
#: Bytes of text whose words are looked up at once.
LOOKUP_BYTES = 3 << 20


class ChunkTable:
    """Ids and surface of whole texts, by chunks."""

    def __init__(self, path: str, max_entries: int = MAX_ENTRIES):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        if any(a != MARK and b == MARK for p in pieces for a, b in zip(p, p[1:])):
            raise ValueError("a piece crosses a whitespace marker: chunks aren't independent")
        if self.sp.encode("  a ") != self.sp.encode(f"{MARK}{MARK}a{MARK}") or self.sp.decode(self.sp.encode("  a ")) != "  a ":
            raise ValueError("the model's normalizer changes white space")
        self.mark = self.sp.piece_to_id(MARK)
        self.find = re.compile(" +[^ ]*").findall
        self.max_entries = max_entries
        self.ids: dict[str, str] = {}
        self.surface: dict[str, str] = {}

    def _fill(self, rows: list[list[str]]) -> None:
        """Puts all chunks of some texts into the table: their decimal ids, and their decoded text where it is another."""
        here = set().union(*rows)
        new = [c for c in here if c not in self.ids]
        if len(self.ids) + len(new) > self.max_entries:
            self.ids.clear()
            self.surface.clear()
            new = here
        new = list(new)
        # the library itself puts a marker in front, so a chunk goes in without its first one
        coded = [ids or [self.mark] for ids in self.sp.encode([c[1:] for c in new], num_threads=1)] if new else []
        for c, ids, text in zip(new, coded, self.sp.decode(coded) if new else []):
            self.ids[c] = ",".join(map(str, ids))
            if text != c[1:]:
                self.surface[c] = " " + text

    def code(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text the number of ids, the decimal ids joined by commas, the decoded text."""
        rows = [self.find(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        self._fill(rows)
        for t, chunks in zip(texts, rows):
            ids = ",".join(map(self.ids.__getitem__, chunks))
            decoded = "".join([self.surface.get(c, c) for c in chunks])[1:] if self.surface or MARK in t else t
            yield ids.count(",") + 1 if ids else 0, ids, decoded


def piece_digests(docs: DataFrame, path: str, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs.

    A null text counts as empty: no ids, digests of the empty string. Repeated rows and ids each give their own row;
    a null id stays null. Other columns are ignored, whatever their names. An empty table gives an empty table.
    """

    def run(batches):
        chunks = ChunkTable(path, max_entries)
        for b in slices(batches, "text", LOOKUP_BYTES):
            n, ids, decoded = [], [], []
            for k, i, d in chunks.code([t or "" for t in b.column("text").to_pylist()]):
                n.append(k)
                ids.append(hashlib.sha256(i.encode()).hexdigest())
                decoded.append(hashlib.sha256(d.encode()).hexdigest())
            yield {"doc_id": b.column("doc_id"), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

    return map_arrow(texts(docs), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """doc_id and the ids themselves (array<int>); null and empty texts give an empty array."""

    def run(batches):
        chunks = ChunkTable(path, max_entries)
        for b in slices(batches, "text", LOOKUP_BYTES):
            rows = [r[1] for r in chunks.code([t or "" for t in b.column("text").to_pylist()])]
            yield {"doc_id": b.column("doc_id"), "ids": [list(map(int, r.split(","))) if r else [] for r in rows]}

    return map_arrow(texts(docs), run, "doc_id bigint, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids) by the library's decode; null ids give a null text."""

    def run(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for b in batches:
            yield {"doc_id": b.column("doc_id"), "text": [None if i is None else sp.decode(i) for i in b.column("ids").to_pylist()]}

    return map_arrow(coded.select("doc_id", "ids"), run, "doc_id bigint, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(spread(table(spark, sf_dir, "documents")), public_tokenizers.path(MODEL))


ORACLE_SQL = None  # merges of a vocabulary can't be said in SQL
