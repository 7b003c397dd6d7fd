"""Token counts of sections, by encoding whole documents once.

A document is encoded as a whole, never section by section. Each token covers a span of characters; an
interval join against the sections' spans gives its section. A token that crosses a boundary goes, whole,
to the section that holds most of its characters, and to the earlier one where two hold as many, so the
sections' counts add up to the document's.

Sections are the lines of a text; a line's \\n belongs to the line it ends. Defined results: a null or
empty text has one section of no characters and no tokens; a byte-level token that covers only part of
a character spans that character.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import kept_encoder
from .common import arrow_map, batch, documents, texts

SCHEMA = "doc_id long, section long, start long, end long, n_tokens long, n_crossing long, doc_tokens long"
_OUT = pa.schema([(n, pa.int64()) for n in ("doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens")])


def line_sections(text: str) -> np.ndarray:
    """Where each line ends, its \\n included."""
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"] if "\n" in text else []
    return np.array(ends if ends and ends[-1] == len(text) and len(text) else [*ends, len(text)], np.int64)


def token_spans(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters [start, end) of each token. lengths: bytes of each id."""
    ends = np.cumsum(lengths[ids])
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) == len(text):
        return ends - lengths[ids], ends
    begun = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters that begin before each byte
    first = raw if len(raw) == 0 else np.concatenate([(raw & 0xC0) != 0x80, [True]])
    starts = ends - lengths[ids]
    return begun[starts] - ~first[starts], begun[ends]


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross a boundary. sections: where each ends."""
    a = np.searchsorted(sections, starts, "right")
    z = np.searchsorted(sections, np.maximum(ends - 1, starts), "right")
    a, z = np.minimum(a, len(sections) - 1), np.minimum(z, len(sections) - 1)
    crossing = a != z
    for i in np.flatnonzero(crossing):
        edges = np.concatenate([[starts[i]], sections[a[i] : z[i]], [ends[i]]])
        a[i] += int(np.diff(edges).argmax())
    return np.bincount(a, minlength=len(sections)), np.bincount(a[crossing], minlength=len(sections))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """A row for each section: its characters, its tokens, those that cross into another, the document's tokens."""
    with open(path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    key = uuid.uuid4().hex

    def run(batches):
        encoder = kept_encoder(key, vocabulary.value)
        lengths = np.array([len(b) for b in encoder.vocabulary.bytes_of], np.int64)
        for b in batches:
            many = texts(b["text"])
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            repeat = []
            for text, encoded in zip(many, encoder.encode(many), strict=True):
                ids = np.frombuffer(encoded, "<u4")
                sections = line_sections(text)
                tokens, crossing = attribute(*token_spans(text, ids, lengths), sections) if len(ids) else (np.zeros(len(sections), np.int64),) * 2
                n = len(sections)
                repeat.append(n)
                for c, x in zip(columns, (np.arange(n), np.concatenate([[0], sections[:-1]]), sections, tokens, crossing, np.full(n, len(ids))), strict=True):
                    c.append(x)
            of = np.repeat(np.arange(b.num_rows), repeat)
            for i in range(0, len(of) or 1, 100_000):
                yield batch(_OUT, b["doc_id"].take(pa.array(of[i : i + 100_000])), *[pa.array(np.concatenate(c)[i : i + 100_000].astype(np.int64)) if c else pa.array([], pa.int64()) for c in columns])

    return arrow_map(documents(docs), run, SCHEMA)
