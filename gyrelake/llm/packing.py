"""Best-fit packing of token sequences by a configuration linear program.

1. Texts become token ids plus an end id; only documents over the capacity are cut (the first
   piece takes the remainder). One row for each piece is written, without its ids.
2. The histogram of piece lengths (at most ``capacity`` rows) goes to the driver. The
   configuration program min sum(x_c), sum(a_cl x_c) >= n_l is solved by multiplicative weights:
   every round prices a configuration by an unbounded knapsack over the present weights, adds
   copies of it, and lowers the weights of what it covers, until every length is covered; weights over
   the greatest weight of a configuration are dual prices and bound the program from below. Passes
   that end more than ``GAP`` above the bound are followed by others with weights raised where room was left.
3. The fractional copies are rounded down within the supply; what the rounding leaves is packed by
   exact subset sums around its longest length, each pattern as often as the supply allows.
4. A pattern's places are ranges of ranks among the pieces of one length, so that each piece
   finds its sequence and offset from its own rank; no group of pieces meets in one task.

Nulls: a null text is an empty one and gives a piece of the end id alone; null ids stay. Repeated
rows are packed one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import codecs
import itertools
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyrelake.llm.common import Scratch, TwoGenerations, claim, slices

CAPACITY, END_ID = 1024, 2
RATE, GAP, EPOCHS = 0.1, 0.002, 3
#: What is left of a length below this is rounding of doubles.
LEAST = 1e-6
#: Bytes of new cuts that a worker remembers, twice; bytes of a long text that are cut at once.
CACHE, WINDOW = 240 << 20, 1 << 20
#: A word of Latin letters; a cut of printable characters and Latin letters.
_WORD, _LINE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+"), re.compile(r" ?[!-~À-ÖØ-öø-ÿ]+")

#: Classes of bytes: ASCII letters, digits, punctuation, the apostrophe, the space, other white space, letters of
#: Latin-1, characters with cuts before white space alone, and those (odd white space) without any cut beside them.
_A, _D, _P, _Q, _S, _W, _L, _X, _U = range(9)
_CLASS = np.full(256, _X, np.uint8)
_CLASS[0x21:0x7F] = _P
for _kind, _chars in ((_A, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), (_D, b"0123456789"), (_Q, b"'"), (_S, b" "), (_W, b"\t\n\r"), (_U, b"\x0b\x0c\x1c\x1d\x1e\x1f")):
    _CLASS[list(_chars)] = _kind
#: What a pair of classes says of the place between them: a token ends there; white space on both sides; white space
#: before another character; the same for one that is no space.
_CUT, _INSIDE, _LAST, _ALONE = 1, 2, 4, 8
_PAIR = np.zeros(256, np.uint8)
for _a, _bs in ((_A, (_P, _Q, _D)), (_L, (_P, _Q, _D)), (_D, (_A, _L, _P, _Q)), (_P, (_A, _L, _D)), (_Q, (_D,))):
    _PAIR[[_a << 4 | _b for _b in _bs]] = _CUT
for _a in (_A, _D, _P, _Q, _L, _X):
    _PAIR[[_a << 4 | _S, _a << 4 | _W]] = _CUT
    _PAIR[[_S << 4 | _a, _W << 4 | _a]] = _LAST, _LAST | _ALONE
_PAIR[[_S << 4 | _S, _S << 4 | _W, _W << 4 | _S, _W << 4 | _W]] = _INSIDE


def _codes(chars: str) -> np.ndarray:
    """Characters of three bytes as numbers."""
    return np.array([int.from_bytes(c.encode(), "big") for c in chars], np.uint32)


_ODD = _codes("\u1680\u180e\u205f\u3000" + "".join(map(chr, [*range(0x2000, 0x2010), *range(0x2028, 0x2030)])))
_MARKS = _codes("".join(map(chr, range(0x2010, 0x2028))))  # dashes, quotes, dots

_loaded: dict[str, WordIds] = {}


def classes(data: np.ndarray) -> np.ndarray:
    """The class of every byte of UTF-8 texts; all bytes of a character have the same."""
    kinds = _CLASS[data]
    if data.max(initial=0) < 0x80:
        return kinds
    at = np.flatnonzero(data == 0xC3)
    at = at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]
    kinds[at] = kinds[at + 1] = _L
    at = np.flatnonzero(data == 0xC2)
    at = at[data[at + 1] <= 0xA0]
    kinds[at] = kinds[at + 1] = _U
    at = np.flatnonzero((data >= 0xE1) & (data <= 0xE3))
    code = data[at].astype(np.uint32) << 16 | data[at + 1].astype(np.uint32) << 8 | data[at + 2]
    for kind, codes in ((_U, _ODD), (_P, _MARKS)):
        found = at[np.isin(code, codes)]
        kinds[found] = kinds[found + 1] = kinds[found + 2] = kind
    return kinds


def cut_starts(data: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Where the cuts of texts begin that lie one after another in ``data``, from one of ``offsets`` to the next.

    A cut begins with its text, and where a token of the pattern ends at any rate: between letters, digits and
    punctuation (but not behind an apostrophe, which may join), before white space, before the last of several white
    spaces, which goes with what follows, and behind a single one that is no space. None is beside or in a special token.
    """
    kinds = classes(data)
    pair = _PAIR[kinds[:-1] << 4 | kinds[1:]]
    begins = np.zeros(len(data), bool)
    begins[1:] = pair & _CUT
    at = np.flatnonzero(pair & _INSIDE) + 1
    at = at[at < len(pair)]
    begins[at[pair[at] & _LAST > 0]] = True
    at = np.flatnonzero(pair & _ALONE) + 1
    begins[at[(at < 2) | (kinds[at - 2] != _U)]] = True
    filled = offsets[1:] > offsets[:-1]
    last = offsets[1:][filled] - 1  # no other text follows here
    last = last[last > 0]
    begins[last] = pair[last - 1] & _CUT
    if special:
        raw = data.tobytes()
        for token in special:
            at = raw.find(token)
            while at >= 0:
                begins[max(at - 1, 0) : at + len(token)] = False
                at = raw.find(token, at + 1)
    begins[offsets[:-1][filled]] = True
    return np.flatnonzero(begins)


class WordIds:
    """Token ids, as bytes of little-endian uint32, by a byte-level BPE of the tokenizers library.

    Texts are cut where the pre-tokeniser's pattern ends a token whatever else they hold, and each distinct cut
    (Arrow's dictionary of a batch) is encoded once; many at once as one text: words that begin with a space in a row,
    as none but their first tokens begin with one, and others as lines, since a line feed between them is a token of
    its own. A row goes to the library's model without the pattern, as it is known to leave words whole. A tokenizer
    with another pattern is given whole texts.
    """

    def __init__(self, model: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(model)
        self.encode = tokenizer.encode_batch_fast
        self.cache = TwoGenerations(CACHE)
        rules = json.loads(tokenizer.to_str())
        pattern, added = rules["pre_tokenizer"] or {}, rules["added_tokens"]
        self.special = [t["content"].encode() for t in added]
        self.cuts = pattern.get("type") == "ByteLevel" and pattern.get("use_regex", True) and not pattern["add_prefix_space"] and not any(rules[k] for k in ("normalizer", "truncation", "padding")) and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or any(map(str.isspace, t["content"])) for t in added)
        self.line = self._ids(["\n"])[0]
        tokens = tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(tokens.values(), default=0) + 1, bool)  # tokens that begin with a space
        self.begins[[i for t, i in tokens.items() if t.startswith("\u0120")]] = True
        self.chars = _byte_chars()
        bare = Tokenizer(tokenizer.model)
        bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.encode_bare = bare.encode_batch_fast
        probe = [" ab", " cd", " ef", " \u00e9\u00c0"]
        self.row = bool(self.cuts and self._row(probe) == self._ids(probe))
        self.lines = len(self.line) == 4 and self._ids(["ab\n cd\nef"])[0] == self.line.join(self._ids(["ab", " cd", "ef"]))

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words without line feeds, encoded as one text."""
        ids = np.frombuffer(self._ids(["\n".join(words)])[0], "<u4")
        ends = np.append(np.flatnonzero(ids == np.frombuffer(self.line, "<u4")[0]), len(ids)).tolist()
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *(x + 1 for x in ends[:-1])], ends, strict=True)]

    def _row(self, words: list[str]) -> list[bytes]:
        """Ids of words that begin with a space, encoded as one text."""
        text = codecs.charmap_decode("".join(words).encode(), "strict", self.chars)[0].replace("\u0120", " \u0120")
        ids = np.array(self.encode_bare([text], add_special_tokens=False)[0].ids, "<u4")
        at = (4 * np.append(np.flatnonzero(self.begins[ids]), len(ids))).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in itertools.pairwise(at)]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.encode(texts, add_special_tokens=False)]

    def of(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        return self.of_column(pa.array(texts, pa.string()))

    def of_column(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (null: empty); a long one goes through in windows that begin with a space."""
        if not self.cuts:
            return self._ids([x or "" for x in texts.to_pylist()])
        texts = texts.cast(pa.large_string()).fill_null("")
        _, ends, chars = texts.buffers()
        offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(chars or b"", np.uint8)
        out: list[bytes] = []
        long = np.diff(offsets) > 2 * WINDOW
        for at, end in itertools.pairwise([0, *(np.flatnonzero(np.diff(long)) + 1).tolist(), len(texts)]):
            if at < end and not long[at]:
                out += self._of(data, offsets[at : end + 1])
            else:
                out += [b"".join(self._of(data, w)[0] for w in _windows(data[: offsets[i + 1]], int(offsets[i]))) for i in range(at, end)]
        return out

    def _of(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of the texts that lie between ``offsets``."""
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        if not len(data):
            return [b""] * (len(offsets) - 1)
        starts = cut_starts(data, offsets, self.special)
        cuts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)).dictionary_encode()
        ids = self._known(cuts.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        which = cuts.indices.to_numpy()
        counts = sizes[which]
        ends = np.append(0, np.cumsum(counts))
        places = np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], counts)
        places += np.arange(ends[-1])
        raw = np.frombuffer(b"".join(ids), "<u4")[places].tobytes()
        return [raw[a:b] for a, b in itertools.pairwise((4 * ends[np.searchsorted(starts, offsets)]).tolist())]

    def _known(self, cuts: list[str]) -> list[bytes]:
        """Ids of distinct cuts, remembered or encoded."""
        found = list(map(self.cache.get, cuts))
        if not (gaps := [i for i, f in enumerate(found) if f is None]):
            return found
        row, words, other = [], [], []
        for c in self.cache.absent({cuts[i] for i in gaps}):
            (row if self.row and c[0] == " " and _WORD.fullmatch(c) else words if self.lines and _LINE.fullmatch(c) else other).append(c)
        for part, encode in ((row, self._row), (words, self._words), (other, self._ids)):
            for at in range(0, len(part), 4096):
                some = part[at : at + 4096]
                self.cache.put(some, encode(some))
        for i in gaps:
            found[i] = self.cache[cuts[i]]
        return found


def _byte_chars() -> str:
    """The character by which a byte-level vocabulary writes each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b if b in plain else next(rest)) for b in range(256))


def _windows(data: np.ndarray, at: int) -> Iterator[np.ndarray]:
    """(start, end) of stretches of some ``WINDOW`` bytes from ``at`` to the end, each but the first beginning with a space behind an ASCII character."""
    while at < len(data):
        to = at + WINDOW
        while to < len(data) and not (data[to] == 0x20 and 0x20 < data[to - 1] < 0x80):
            step = data[to + 1 : to + 1 + WINDOW] == 0x20
            to = to + 1 + int(step.argmax()) if step.any() else min(to + 1 + WINDOW, len(data))
        to = min(to, len(data))
        yield np.array([at, to])
        at = to


def pieces_of(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first piece takes the remainder."""
    first = length % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def token_pieces(docs: DataFrame, model: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece, with the writing task (pid) and the piece's rank in it among its length (nth)."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _loaded.get(model)
        if words is None:
            words = _loaded[model] = WordIds(model)
        claim("packing", words.cache)
        seen, pid = Counter(), TaskContext.get().partitionId()
        for part in slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for row, ids in enumerate(words.of_column(part.column(1))):
                ids += end
                for k, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    for column, value in zip(out, (row, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), seen[length]), strict=True):
                        column.append(value)
                    seen[length] += 1
            yield pa.record_batch({"doc_id": part.column(0).take(pa.array(out[0], pa.int64())), "piece": pa.array(out[1], pa.int32()), "start": pa.array(out[2], pa.int64()), "length": pa.array(out[3], pa.int64()), "ids_crc32": pa.array(out[4], pa.int64()), "nth": pa.array(out[5], pa.int64()), "pid": pa.array([pid] * len(out[0]), pa.int32())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, nth long, pid int")


def price(weights: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of greatest weight: unbounded knapsack by dynamic programming."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    worth = np.full(capacity + 1, -np.inf)  # by length, so that a room needs slices alone
    worth[lengths] = weights
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        value = best[room - 1 :: -1] + worth[1 : room + 1]
        top = int(value.argmax())
        if value[top] > best[room]:
            best[room], took[room] = value[top], top + 1
    config, room = Counter(), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            config[int(took[room])] += 1
            room -= int(took[room])
    return dict(config)


def worth(weights: np.ndarray, lengths: np.ndarray, supply: np.ndarray, capacity: int) -> float:
    """A lower bound of the program: weights over the greatest weight of a configuration are feasible dual prices."""
    at = {int(x): w for x, w in zip(lengths, weights, strict=True)}
    top = sum(at[x] * a for x, a in price(weights, lengths, capacity).items())
    return float(supply @ weights) / top if top > 0 else 0.0


@dataclass
class Program:
    """Configurations with fractional copies that cover the supply, their number of sequences and a lower bound of it."""

    configs: list[tuple[dict[int, int], float]]
    value: float
    bound: float

    @property
    def gap(self) -> float:
        return self.value / self.bound - 1 if self.bound else 0.0


def cover(lengths: np.ndarray, supply: np.ndarray, weights: np.ndarray, capacity: int, rate: float) -> list[tuple[dict[int, int], float]]:
    """Configurations and their fractional copies in one pass over the supply.

    A round takes the configuration of greatest weight as often as the uncovered supply allows; the
    weights of what it uses fall by (1 - rate) for their covered share, and a length that is wholly
    covered leaves, so that nothing is covered twice. It ends when every length is covered, so that the copies
    are a solution of the program; a round covers one length at least, so there are at most ``capacity`` rounds.
    """
    weights, left, found = weights.copy(), supply.copy(), Counter()
    at = {int(x): k for k, x in enumerate(lengths)}
    while len(active := np.flatnonzero(left > LEAST)):
        config = price(weights[active], lengths[active], capacity)
        step = min(left[at[x]] / a for x, a in config.items())
        found[tuple(sorted(config.items()))] += step
        for x, a in config.items():
            left[at[x]] -= a * step
            weights[at[x]] *= (1 - rate) ** (a * step / supply[at[x]])
    return [(dict(k), v) for k, v in found.items()]


def fractional(histogram: dict[int, int], capacity: int, rate: float = RATE) -> Program:
    """The configuration program by multiplicative weights, to ``GAP`` of its dual bound or over ``EPOCHS`` passes.

    Long lengths begin with more weight than their share of the capacity, as they fit into fewer
    configurations. After a pass the weight of a length grows by the room that its configurations
    left empty, so that the next pass serves it earlier; the best pass is taken. Every pass gives a
    dual bound by its weights, beside those of the lengths and of the pieces over half the capacity.
    """
    lengths = np.array(sorted(histogram), np.int64)
    supply = np.array([histogram[int(x)] for x in lengths], float)
    if not len(lengths):
        return Program([], 0.0, 0.0)
    share = lengths / capacity
    weights, best = share**1.1, Program([], np.inf, max(worth(w, lengths, supply, capacity) for w in (share, (share > 0.5).astype(float))))
    for _ in range(EPOCHS):
        best.bound = max(best.bound, worth(weights, lengths, supply, capacity))
        configs = cover(lengths, supply, weights, capacity, rate)
        if (value := sum(v for _, v in configs)) < best.value:
            best.configs, best.value = configs, value
        if best.gap <= GAP:
            break
        empty = np.zeros(len(lengths))
        for config, copies in configs:
            room = 1 - sum(x * a for x, a in config.items()) / capacity
            for x, a in config.items():
                k = int(np.searchsorted(lengths, x))
                empty[k] += room * a * copies / supply[k]
        weights = weights * (1 + rate) ** (empty / max(empty.max(), 1e-12))
    return best


def subset_patterns(left: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Packs the rest: around the longest length, the subset that fills the sequence best, as often as it can be had."""
    left = {k: v for k, v in left.items() if v}
    while left:
        longest = max(left)
        room, reach, steps = capacity - longest, 1, []
        for x in sorted(left, reverse=True):
            if x > room:
                continue
            n, size = min(left[x] - (x == longest), room // x), 1
            while n > 0:  # binary splitting of the copies
                k = min(size, n)
                steps.append((x, k, reach))
                reach |= (reach << (k * x)) & ((1 << (room + 1)) - 1)
                n -= k
                size *= 2
            if reach >> room & 1:
                break
        filled = reach.bit_length() - 1
        pattern = Counter({longest: 1})
        for x, k, before in reversed(steps):
            if not before >> filled & 1:
                pattern[x] += k
                filled -= k * x
        times = min(left[x] // a for x, a in pattern.items())
        for x, a in pattern.items():
            left[x] -= a * times
            if not left[x]:
                del left[x]
        yield dict(pattern), times


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often each is used; together they use every piece exactly once."""
    left, out = dict(histogram), []
    if full := left.pop(capacity, 0):
        out.append(({capacity: 1}, full))
    for config, copies in sorted(fractional(left, capacity).configs, key=lambda c: -sum(x * a for x, a in c[0].items())):
        times = min(int(copies + 1e-6), *(left[x] // a for x, a in config.items()))
        if times > 0:
            out.append((config, times))
            for x, a in config.items():
                left[x] -= a * times
    return out + list(subset_patterns(left, capacity))


def places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length its ranges of ranks: (first rank, copies in a sequence, first sequence, offset)."""
    found: dict[int, list] = {}
    used, sequence = Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for x in sorted(pattern, reverse=True):
            found.setdefault(x, []).append((used[x], pattern[x], sequence, offset))
            used[x] += pattern[x] * times
            offset += pattern[x] * x
        sequence += times
    return found


def pack(spark: SparkSession, docs: DataFrame, model: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    scratch = Scratch(spark, "pack")
    pieces = scratch.write("pieces", token_pieces(docs, model, capacity, end_id))
    counts = scratch.write("counts", pieces.groupBy("length", "pid").agg(F.count("*").alias("n")))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    found = places(plan(histogram, capacity))
    starts = {x: [r[0] for r in rows] for x, rows in found.items()}
    before = counts.select("length", "pid", (F.sum("n").over(Window.partitionBy("length").orderBy("pid")) - F.col("n")).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences, offsets = [], []
            for x, rank in zip(batch["length"].to_pylist(), batch["rank"].to_pylist(), strict=True):
                first, a, sequence, offset = found[x][bisect.bisect_right(starts[x], rank) - 1]
                sequences.append(sequence + (rank - first) // a)
                offsets.append(offset + (rank - first) % a * x)
            yield pa.record_batch([batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # a row of ``before`` for each length and task: it grows with the tasks, so it is not broadcast
    ranked = pieces.join(before.hint("merge"), ["length", "pid"]).withColumn("rank", F.col("nth") + F.col("base"))
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
