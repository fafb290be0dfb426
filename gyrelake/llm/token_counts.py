"""Token counts: Arrow functions that return lengths only.

A text is cut at boundaries that no piece of the vocabulary can cross (before a run of spaces
that follows a non-space, and around line feeds), distinct cuts are encoded once, in batches
balanced by bytes, and their lengths are added up. A long cut (a text without spaces) is cut again between
two ASCII characters that no piece has side by side. Whether the vocabulary allows these cuts is
checked when it is loaded; one that does not is given whole texts.

Nulls: a null text counts as empty; a null id is kept. Empty texts have 0 tokens and 0 bytes.
Repeated rows are counted one by one; other columns of the input are ignored, whatever their
names. Very long texts are cut a window at a time. What a worker remembers is bounded in bytes, and long cuts are not
remembered. Only a long run without any safe boundary (one letter a million times, say) is encoded in one piece.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gyrelake.llm.common import TwoGenerations, claim, groups, windows

_CUTS = re.compile("\n[^ ▁\n]*|[ ▁]+[^ ▁\n]+|[^ ▁\n]+|[ ▁]+")
BATCH_BYTES, WINDOW, PART = 1 << 20, 1 << 20, 4096
#: Bytes of new cuts that a worker remembers, twice.
CACHE = 64 << 20
OVER = 4096

_loaded: dict[str, PieceLengths] = {}


def size_of(text: str) -> int:
    """Bytes of a text in UTF-8."""
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def balanced(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Lists of texts of about equal bytes: longest first, a list ends when it is full."""
    part, size = [], 0
    for text in sorted(texts, key=len, reverse=True):
        part.append(text)
        size += size_of(text)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


class PieceLengths:
    """Token counts by a sentencepiece model."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.cuts = not any(re.search("[^▁]▁|\n", p) for p in pieces) and len(self.sp.encode("a\n b", out_type=str)) >= 3 and self.sp.encode(" ", out_type=str) != []
        self.cache = TwoGenerations(CACHE)
        self.one, self.line = len(self.sp.encode("a")), len(self.sp.encode("\n"))
        self.apart = self._apart(pieces)

    @staticmethod
    def _apart(pieces: list[str]) -> np.ndarray:
        """[a, b]: ASCII characters that are pieces themselves and stand side by side in no piece, so that none crosses them."""
        alone = np.zeros(128, bool)
        alone[[ord(p) for p in pieces if len(p) == 1 and "!" <= p <= "~"]] = True
        apart = alone[:, None] & alone[None, :]
        for p in pieces:
            for a, b in itertools.pairwise(p):
                if a < "\x80" and b < "\x80":
                    apart[ord(a), ord(b)] = False
        return apart

    def parts(self, cut: str) -> list[str]:
        """A long cut as stretches of some ``PART`` characters that end at safe boundaries."""
        if len(cut) <= PART:
            return [cut]
        points = np.frombuffer(cut.encode("utf-32-le", "surrogatepass"), "<u4")
        ascii_ = np.where(points < 128, points, 0)
        safe = np.flatnonzero(self.apart[ascii_[:-1], ascii_[1:]]) + 1
        ends = [0]
        while (k := int(np.searchsorted(safe, ends[-1] + PART))) < len(safe):
            ends.append(int(safe[k]))
        return [cut[a:b] for a, b in itertools.pairwise([*ends, len(cut)])]

    def _ask(self, cut: str) -> str:
        """What is encoded for a cut that is not the first of its text."""
        if cut[0] == "\n":
            return cut
        return "a" + cut if not cut.strip(" ▁") else cut[1:]

    def _more(self, parts: list[str]) -> int:
        """Tokens of the parts of a long cut behind its first one."""
        return sum(len(self.sp.encode("\n" + p)) - self.line for p in parts)

    def _encode(self, cuts: list[str]) -> None:
        long = [c for c in cuts if len(c) > PART]
        for part in balanced([c for c in cuts if len(c) <= PART] if long else cuts):
            ids = self.sp.encode([self._ask(c) for c in part], num_threads=1)
            self.cache.put(part, [len(i) - (1 if c[0] == "\n" else self.one if not c.strip(" ▁") else 0) for c, i in zip(part, ids, strict=True)])
        for cut in long:
            first, *rest = self.parts(cut)
            n = len(self.sp.encode(self._ask(first))) - (1 if cut[0] == "\n" else self.one if not first.strip(" ▁") else 0)
            self.cache.put([cut], [n + self._more(rest)])

    def lengths(self, texts: list[str]) -> list[int]:
        if not self.cuts:
            return [len(self.sp.encode(t)) for t in texts]
        if max(map(len, texts), default=0) <= 2 * WINDOW:
            return self._lengths(list(map(_CUTS.findall, texts)), begins=True)
        out = [0] * len(texts)
        long = [i for i, t in enumerate(texts) if len(t) > 2 * WINDOW]
        for i in long:
            for k, part in enumerate(windows(texts[i], WINDOW)):
                out[i] += self._lengths([_CUTS.findall(part)], begins=not k)[0]
        rest = [i for i, t in enumerate(texts) if len(t) <= 2 * WINDOW]
        for i, n in zip(rest, self._lengths([_CUTS.findall(texts[i]) for i in rest], begins=True), strict=True):
            out[i] = n
        return out

    def _lengths(self, cut: list[list[str]], begins: bool) -> list[int]:
        """Tokens of texts that are given as cuts; ``begins``: their first cut begins a text."""
        skip = int(begins)
        if missing := self.cache.absent(set(itertools.chain.from_iterable(c[skip:] for c in cut))):
            self._encode(missing)
        heads = [self.parts(c[0]) if begins and c else [""] for c in cut]
        first = [len(x) for x in self.sp.encode([h[0] for h in heads], num_threads=1)] if begins else [0] * len(cut)
        return [f + self._more(h[1:]) + sum(map(self.cache.__getitem__, c[skip:])) for f, h, c in zip(first, heads, cut, strict=True)]


def count_tokens(docs: DataFrame, model: str, over: int = OVER) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``over`` tokens) of every row of ``docs``.

    ``model`` is the path of a sentencepiece model that every worker can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _loaded.get(model)
        if counter is None:
            counter = _loaded[model] = PieceLengths(model)
        claim("token counts", counter.cache)
        for part, texts in groups(batches):
            n = counter.lengths(texts)
            yield pa.record_batch({"doc_id": part.column(0), "n_bytes": pa.array(list(map(size_of, texts)), pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > over for x in n], pa.bool_())})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
