"""BPE encoding and decoding, equal to the tokenizers library's, by tree concatenation.

A text longer than a leaf is halved until every piece is a leaf; all leaves of a
batch are encoded in parallel; then neighbours are joined up the tree. At a join
only a window around it is encoded again, from a token of the left half to a
token of the right half. The window grows twofold until its first tokens are
those of the left half and its last tokens those of the right half; then every
pair of adjacent tokens stands as in an encoding of the whole, which determines
it. A window neither starts nor ends where the pre-tokeniser could read its edge
otherwise than in the whole text: inside a run of white space or at an
apostrophe. Where the halves never agree, the window ends as the whole text.

Special tokens are cut out first, as the library does, so no piece is cut in one.

Defined results. A null or empty text has no ids and decodes to the empty
string. Any length of text is encoded whole. Repeated rows give repeated rows;
an empty table gives none; columns other than the id and the text are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import byte_slices

LEAF_CHARS = 4096
#: Tokens on either side of a join at first, and how many must agree.
WINDOW, AGREE = 8, 2
#: Characters that both libraries class alike: no white space but the ASCII kind, no letter of newer scripts.
_PLAIN = re.compile("[^\t\n\r -~\xa1-ɏ]")


def _byte_of() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means: a byte that prints stands for itself, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _before(text: bytes, at: int) -> str:
    """The character that ends before at."""
    return text[max(0, at - 4) : at].decode("utf-8", "ignore")[-1:]


class ByteBPE:
    """A byte-level vocabulary of the tokenizers library, read from its file."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, threads: int = 2, pattern: str | None = None):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_of()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.piece = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.piece[i] = bytes(byte[c] for c in token)
        for token, i in self.special.items():
            self.piece[i] = token.encode()
        self.size = [len(x) for x in self.piece]
        self.leaf_chars, self.threads = max(1, leaf_chars), threads
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.slow.encode_special_tokens = True
        self.fast = None
        if pattern:
            import tiktoken

            ranks = {self.piece[i]: i for i in vocab.values()}
            self.fast = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _leaves(self, texts: list[str]) -> list[list[int]]:
        """Ids of pieces without special tokens. The rank merger is used where its pre-tokeniser is sure to agree."""
        out: list[list[int]] = [[]] * len(texts)
        plain = [i for i, x in enumerate(texts) if self.fast and not _PLAIN.search(x)]
        for i, ids in zip(plain, self.fast.encode_ordinary_batch([texts[i] for i in plain], num_threads=self.threads) if plain else [], strict=True):
            out[i] = ids
        known = set(plain)
        other = [i for i in range(len(texts)) if i not in known]
        for i, e in zip(other, self.slow.encode_batch_fast([texts[i] for i in other], add_special_tokens=False) if other else [], strict=True):
            out[i] = e.ids
        return out

    def _ids(self, text: str) -> list[int]:
        if self.fast and not _PLAIN.search(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids

    def _join(self, text: bytes, start: int, mid: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of text[start:end] from those of its parts before and behind mid."""
        k = WINDOW
        while True:
            i, a = len(left), mid
            while i and (len(left) - i < k or not self._may_start(text, start, a)):
                i -= 1
                a -= self.size[left[i]]
            j, b = 0, mid
            while j < len(right) and (j < k or not self._may_end(text, b, end)):
                b += self.size[right[j]]
                j += 1
            window = self._ids(text[a:b].decode())
            if (i == 0 or window[:AGREE] == left[i : i + AGREE]) and (j == len(right) or window[-AGREE:] == right[j - AGREE : j]):
                return left[:i] + window + right[j:]
            k *= 2

    @staticmethod
    def _may_start(text: bytes, start: int, a: int) -> bool:
        """A token starts at a. Is it read from there as it is within the text?"""
        if a <= start:
            return True
        if text[a] & 0xC0 == 0x80:
            return False
        here = text[a : a + 4].decode("utf-8", "ignore")[:1]
        return here != "'" and not (here.isspace() and _before(text, a).isspace())

    @staticmethod
    def _may_end(text: bytes, b: int, end: int) -> bool:
        if b >= end:
            return True
        before = _before(text, b)
        return text[b] & 0xC0 != 0x80 and before != "'" and not before.isspace()

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each whole text."""
        leaves: list[str] = []
        plans: list[list] = []

        def plan(text: str):
            """A leaf's number, or (its halves, the left half's bytes)."""
            if len(text) <= self.leaf_chars:
                leaves.append(text)
                return len(leaves) - 1
            half = len(text) // 2
            return plan(text[:half]), plan(text[half:]), len(text[:half].encode())

        for text in texts:
            parts = self.cut.split(text or "") if self.cut else [text or ""]
            plans.append([(p, None if p in self.special else plan(p)) for p in parts if p])
        ids = self._leaves(leaves)

        def grow(node, text: bytes, start: int, end: int) -> list[int]:
            if isinstance(node, int):
                return ids[node]
            mid = start + node[2]
            return self._join(text, start, mid, end, grow(node[0], text, start, mid), grow(node[1], text, mid, end))

        out = []
        for parts in plans:
            got: list[int] = []
            for text, node in parts:
                if node is None:
                    got.append(self.special[text])
                else:
                    raw = b"" if isinstance(node, int) else text.encode()
                    more = grow(node, raw, 0, len(raw))
                    got = got + more if got else more
            out.append(got)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.piece.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[tuple, ByteBPE] = {}


def loaded(path: str, pattern: str | None = None) -> ByteBPE:
    """The vocabulary, read once by each worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(path, pattern=pattern)
    return _loaded[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian unsigned 32-bit integers, and the text that they decode to."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for b in byte_slices(batches):
            got = bpe.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([np.array(x, "<u4").tobytes() for x in got], pa.binary()), pa.array([bpe.decode(x) for x in got], pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, ids binary, decoded string")


def digest(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode_documents()."""
    return encoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
