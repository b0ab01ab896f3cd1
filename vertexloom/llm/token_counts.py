"""Token counts by overlap resynchronisation.

Texts up to ``CHUNK`` characters are encoded whole. A huge one is encoded in overlapping chunks with offsets. The
pre-tokeniser scans from left to right and what it matches from a place on depends on no text before it, so a place
where a pre-token of the chunk on the left ends, far enough from that chunk's end to be out of reach of its cut (``REACH``
characters), and where one of the chunk on the right begins too, is a boundary of the whole text: tokens are spliced
there. If the overlap holds no such place it is doubled, and in the end the rest is encoded in one go.

Ids are those of the tokenizer file. Where it is a byte-level BPE whose ids are its merge ranks, short texts go
through an equal and faster encoder (the two agree on every code point, see the tests).
Special strings in texts are handled as the tokenizer does by default (as special tokens).
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm._shared import arrow_map, slices

CHUNK, OVERLAP, REACH = 1 << 15, 1 << 10, 64
#: Long runs are left to the tokenizer itself, whose time on them is not quadratic.
_LONG = 4096
_SPACES = re.compile(rf"\s{{{_LONG}}}")


def _runs(text: str) -> bool:
    """Whether ``_LONG`` characters in a row are white space, or none of them is."""
    if len(text) < _LONG:
        return False
    sizes = list(map(len, text.split()))
    return max(sizes, default=0) >= _LONG or (len(text) - sum(sizes) >= _LONG and _SPACES.search(text) is not None)


class Encoder:
    """Token ids of texts; made once for each worker and file."""

    made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.fast, self.special = None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if self._ranked(spec):
            self._quick(spec["model"])

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    @staticmethod
    def _ranked(spec: dict) -> bool:
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec.get("added_tokens", []))
        plain = plain and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec.get("normalizer") is None and model["type"] == "BPE" and not model.get("dropout")
        if not plain:
            return False
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        return all(model["vocab"].get(a + b) == 256 + k for k, (a, b) in enumerate(pairs))

    def _quick(self, model: dict) -> None:
        import tiktoken

        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(visible))}
        ranks = {bytes(byte[c] for c in token): k for token, k in model["vocab"].items() if k < 256 + len(model["merges"])}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.fast = tiktoken.Encoding("quick", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _can(self, text: str) -> bool:
        return self.fast is not None and not _runs(text) and not any(s in text for s in self.special)

    def ids(self, text: str) -> np.ndarray:
        if len(text) > CHUNK:
            return self.spliced(text)
        if self._can(text):
            return np.asarray(array("I", self.fast.encode_ordinary(text)))
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)

    def _boundaries(self, text: str) -> tuple[np.ndarray, dict[int, int]]:
        """Ids, and for each character place where a pre-token begins the number of ids before it."""
        e = self.exact.encode(text, add_special_tokens=False)
        begins, last = {}, None
        for k, (word, (at, _)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
            if word is None or word != last:
                begins[at] = k
            last = word
        return np.array(e.ids, np.uint32), begins

    def spliced(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
        """Ids of a huge text; a chunk's are held at a time, with offsets, and plain ids of the rest."""
        out, start, limit = [], 0, chunk
        ids, begins = self._boundaries(text[:limit])
        while limit < len(text):
            over, found = overlap, None
            while found is None:
                behind = max(start, limit - over)
                ahead = min(len(text), limit + chunk)
                more, others = self._boundaries(text[behind:ahead])
                common = [p for p in begins if behind - start < p <= limit - start - REACH and p + start - behind in others and p + start - behind >= REACH]
                if common:
                    found = max(common)
                elif behind == start:  # the overlap is the whole chunk: widen it to the right instead
                    ids, begins = more, others
                    break
                else:
                    over *= 2
            if found is not None:
                out.append(ids[: begins[found]])
                cut_at = found + start
                ids = more[others[cut_at - behind] :]
                first = others[cut_at - behind]
                begins = {p + behind - cut_at: k - first for p, k in others.items() if k >= first}
                start = cut_at
            limit = ahead
        return np.concatenate([*out, ids])


def encoded(path: str, texts: list[bytes]) -> list[np.ndarray]:
    encoder = Encoder.of(path)
    return [encoder.ids(t.decode("utf-8", "replace")) for t in texts]


def counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row; a null text is empty.

    Rows: one for each document; repeated rows and null ids are counted alike. What is not UTF-8 in a text counts with its
    bytes and is encoded as replacement characters. Other columns are not read.
    """

    def counted(batches):
        for batch, texts in slices(batches):
            n = [len(i) for i in encoded(path, texts)]
            yield pa.record_batch([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), counted, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
