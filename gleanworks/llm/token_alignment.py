"""Alignment of two tokenizers' tokens by galloping intersection of their ends.

Both tokenizers cut the same bytes; a token's end is the number of bytes up to it. Of a text's two sorted end lists the shorter drives: each of its ends is searched in the longer one by
steps that double until they pass it and then halve, from the place where an earlier end was found. Ends in both lists cut the tokens into groups. The place of an end in the other list
is its rank there; the ranks of a token's two ends are the range of tokens that it overlaps, so links come from differences of ranks, without comparing tokens.

A text is given to the tokenizers in pieces, cut where neither can join tokens (``Tokenizers`` says why); a piece that occurs again is looked up. Ends and searches are those of whole texts. Texts are tokenized once, into a table of ids in the shared
folder that is removed at the end; it is read twice: pairs of linked ids are counted, pre-aggregated in the tasks; then each text's links meet their
pairs' counts. Counts of pairs above ``COMMON`` of all links go to the tasks (at most 1 / COMMON of them), the rest meet theirs in a join. The highest count per B id is at most one number for each entry of B.

Defined cases: texts that are null or empty, or whose tokens' bytes are not the text with a blank before it, have no tokens: zeros and no groups; they add to no count. Repeated rows
count each. An empty table gives an empty result. Very long texts are a batch of their own (about 150 bytes a token in the task). Other columns are kept; columns named like the added ones are replaced.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .common import batches, query, read, remove, written

TOKENIZERS = "/opt/tokenizers"  # the same folder on every machine
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
COMMON = 1e-6
TASK_BYTES = 2 << 20  # of texts or ids worked on at once
PARTS, RUNS = 300_000, 60_000  # pieces of text whose tokens a task remembers
LEADERS = 32
SHIFT = 24  # a pair of ids as one number
ADDED = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "n_best": "long", "count_sum": "long", "groups": "string"}


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: visible Latin-1 for itself, the others by those from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD = re.compile(rf"[{_LETTERS}]+")
_RUNS = re.compile(rf"[{_LETTERS}]+|\n|[^{_LETTERS}\n]+")
_PLAIN = re.compile(rf"[{_LETTERS}!-&(-/:-@\[-`{{-~\n]+")  # letters, visible ASCII but digits and the apostrophe, line ends
_LINE_ENDS = re.compile(r"\n\n|\n\Z|\A\n")


def _latin(s: str) -> bool:
    """Whether letters are all of those that _LETTERS lists."""
    return s.isascii() or _WORD.fullmatch(s) is not None


def _visible(c: str) -> bool:
    return "!" <= c <= "~" or c.isalnum()


class Tokenizers:
    """Both tokenizers with the bytes of their tokens, and what they made of pieces of text before.

    A text is cut where neither can join tokens. At a blank between visible characters A starts a word, no entry of B holds a blank behind another character, and B itself adds a blank
    before each section. Within a section of letters, line ends and signs, A's words are the runs of letters, of signs, and the single line end; B cannot join two characters that follow each other
    in no entry. What follows from an entry list is read off it here; the tests compare cut with whole texts.
    """

    def __init__(self, folder: str, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(f"{folder}/{a_file}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{b_file}")
        byte_of, entries = _byte_of(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.joined = {p[k:k + 2] for i, p in enumerate(pieces) if not self.b.is_byte(i) for k in range(len(p) - 1)}
        self.line_end = self.b.encode("\n") if not any("\n" in p for p in pieces) else []
        self.len_a, self.len_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.parts: dict[str, tuple[bytes, bytes, bool]] = {}  # between blanks, visible at both ends
        self.runs: dict[tuple[str, bool, bool], tuple[bytes, bytes, bool]] = {}
        self.word = self._word_encoder(f"{folder}/{a_file}")
        self.tails: dict[str, tuple[bytes, bytes]] = {}  # signs that no tokenizer joins to a letter before them
        for c in ".,;:!?)*%&#$" if self.line_end else "":
            a, b = self.word(c.encode()), self.b.encode("\n" + c)[len(self.line_end):]
            if c not in {x[1] for x in self.joined if x[0].isalpha() and _latin(x[0])} and self.bytes_a[a[0]] == self.bytes_b[b[0]] == c.encode():
                self.tails[c] = np.array(a, np.int32).tobytes(), np.array(b, np.int32).tobytes()

    def _word_encoder(self, path: str):
        """A's tokens of one word. Where merges make entries in the order of their numbers, the lowest number that two neighbours make is the next merge."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(vocab[x + y] != 256 + k for k, (x, y) in enumerate(merges)) or model.get("ignore_merges"):
            return lambda word: self.a.encode(word.decode(), add_special_tokens=False).ids
        made = 256 + len(merges)
        return tiktoken.Encoding("a", pat_str=r"[\s\S]+", mergeable_ranks={b: i for i, b in enumerate(self.bytes_a[:made])}, special_tokens={})._core_bpe.encode_single_piece

    @cached_property
    def numerals(self) -> list[str]:
        """Each id with a comma, then each with a bar, then each with a semicolon."""
        n = self.width
        return [f"{i}{c}" for c in ",|;" for i in range(n)]

    @property
    def kind(self):
        return np.uint16 if self.width <= 1 << 16 else np.uint32

    @property
    def width(self) -> int:
        return max(len(self.bytes_a), len(self.bytes_b))

    def sections(self, text: str) -> list[str]:
        parts = text.split(" ")
        if not self.cuts:
            return [text]
        out = [parts[0]]
        for p in parts[1:]:
            if p and out[-1] and _visible(p[0]) and _visible(out[-1][-1]):
                out.append(p)
            else:
                out[-1] += " " + p
        return out

    def _cut(self, section: str) -> list[tuple[str, bool, bool]]:
        """Runs of a section: text, whether it is the first, whether it is one word to A."""
        if self.line_end and _PLAIN.fullmatch(section) and not _LINE_ENDS.search(section):
            runs = _RUNS.findall(section)
            if len(runs) == 1 or not any(x[-1] + y[0] in self.joined for x, y in zip(runs, runs[1:])):
                return [(r, k == 0, True) for k, r in enumerate(runs)]
        return [(section, True, False)]

    def learn(self, sections: list[str], into: dict) -> None:
        """Tokens of new sections: words of letters, alone or with a sign behind them, at once, others put together from their runs."""
        plain, tailed, rest = [], [], []
        for s in sections:
            if s.isalpha() and _latin(s):
                plain.append(s)
            elif s[-1:] in self.tails and (stem := s[:-1]).isalpha() and _latin(stem):
                tailed.append((s, stem))
            else:
                rest.append(s)
        if not self.line_end:
            plain, rest = [], sections
        plain += {stem for _, stem in tailed}.difference(into, plain)
        texts = [(" " + s).encode() for s in plain]
        into.update(zip(plain, self._entries(texts, list(map(self.word, texts)), self.b.encode(plain, num_threads=1))))
        for s, stem in tailed:
            (a, b, same), (tail_a, tail_b) = into[stem], self.tails[s[-1]]
            into[s] = a + tail_a, b + tail_b, same
        cut = list(map(self._cut, rest))
        if len(self.runs) > RUNS:
            self.runs.clear()
        new = list({r for runs in cut for r in runs if r not in self.runs})
        whole = [r for r in new if not r[2]]
        of_whole = dict(zip(whole, [e.ids for e in self.a.encode_batch([" " + r[0] for r in whole], add_special_tokens=False)]))
        texts = [(" " * r[1] + r[0]).encode() for r in new]
        of_a = [self.word(t) if r[2] else of_whole[r] for r, t in zip(new, texts)]
        # B has no beginning without a blank: a line end goes before such runs and is taken off again
        of_b = [b if r[1] else b[len(self.line_end):] for r, b in zip(new, self.b.encode([r[0] if r[1] else "\n" + r[0] for r in new], num_threads=1))]
        self.runs.update(zip(new, self._entries(texts, of_a, of_b)))
        for s, runs in zip(rest, cut):
            got = [self.runs[r] for r in runs]
            into[s] = got[0] if len(got) == 1 else (b"".join([g[0] for g in got]), b"".join([g[1] for g in got]), all([g[2] for g in got]))

    def _entries(self, texts: list[bytes], of_a: list[list[int]], of_b: list[list[int]]) -> Iterator[tuple[bytes, bytes, bool]]:
        """For each text its ids by A and B as bytes, and whether their tokens' bytes are the text."""
        cols, same = [], np.ones(len(texts), bool)
        want = np.fromiter(map(len, texts), np.int64, len(texts))
        for ids, sizes, contents in ((of_a, self.len_a, self.bytes_a), (of_b, self.len_b, self.bytes_b)):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, n.sum())
            ends = np.concatenate([[0], np.cumsum(n)])
            upto = np.concatenate([[0], np.cumsum(sizes[flat])])
            if (upto[ends[1:]] - upto[ends[:-1]] != want).any() or b"".join(map(contents.__getitem__, flat.tolist())) != b"".join(texts):
                same &= [b"".join(map(contents.__getitem__, x)) == t for x, t in zip(ids, texts)]
            packed, at = flat.tobytes(), (4 * ends).tolist()
            cols.append([packed[s:e] for s, e in zip(at, at[1:])])
        return zip(*cols, same.tolist())

    def tokens(self, texts: list[str]) -> Iterator[list[tuple[bytes, bytes, bool]]]:
        """The tokens of each text in pieces."""
        split = [t.split(" ") if t and self.cuts else [] for t in texts]
        if len(self.parts) > PARTS:
            self.parts.clear()
        self.learn([p for p in set().union(*split).difference(self.parts) if p and _visible(p[0]) and _visible(p[-1])], self.parts)
        for t, ps in zip(texts, split):
            got = list(map(self.parts.get, ps)) if t else []
            if t and (not got or None in got):  # parts that begin or end with other characters stay with their neighbours
                odd: dict[str, tuple[bytes, bytes, bool]] = {}
                sections = self.sections(t)
                self.learn([s for s in set(sections) if s not in self.parts], odd)
                got = [self.parts.get(s) or odd[s] for s in sections]
            yield got

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, where each text's begin, ids of B, where each text's begin)."""
        ids_a, ids_b, n_a, n_b = [], [], [0], [0]
        for t, got in zip(texts, self.tokens(texts)):
            a, b = b"".join([g[0] for g in got]), b"".join([g[1] for g in got])
            if not all([g[2] for g in got]):
                whole = b" " + t.encode()
                if any(b"".join(map(of.__getitem__, np.frombuffer(ids, np.int32))) != whole for of, ids in ((self.bytes_a, a), (self.bytes_b, b))):
                    a = b = b""
            ids_a.append(a)
            ids_b.append(b)
            n_a.append(len(a) // 4)
            n_b.append(len(b) // 4)
        return (np.frombuffer(b"".join(ids_a), np.int32).astype(np.int64), np.cumsum(n_a), np.frombuffer(b"".join(ids_b), np.int32).astype(np.int64), np.cumsum(n_b))


@lru_cache(1)
def _loaded(folder: str, a_file: str, b_file: str) -> Tokenizers:
    """The tokenizers of this process."""
    return Tokenizers(folder, a_file, b_file)


def gallop(targets: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each target the first index from ``at`` on whose end is not below it (there is one): steps that double, then halves."""
    low, probe, step = at.copy(), at.copy(), 1
    going = np.flatnonzero(ends[probe] < targets)
    while len(going):
        low[going] = probe[going] + 1
        probe[going] = np.minimum(probe[going] + step, len(ends) - 1)
        step *= 2
        going = going[ends[probe[going]] < targets[going]]
    going = np.flatnonzero(low < probe)
    while len(going):
        middle = (low[going] + probe[going]) // 2
        below = ends[middle] < targets[going]
        low[going[below]] = middle[below] + 1
        probe[going[~below]] = middle[~below]
        going = going[low[going] < probe[going]]
    return probe


def places(short: np.ndarray, long: np.ndarray, from_short: np.ndarray, from_long: np.ndarray) -> np.ndarray:
    """The place in ``long`` of each end of ``short``: every text's LEADERS-th ends from the text's beginning, those between from their leader's place."""
    n = np.diff(from_short)
    text = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(short)) - from_short[:-1][text]
    lead = np.flatnonzero(within % LEADERS == 0)
    out = np.empty(len(short), np.int64)
    out[lead] = gallop(short[lead], long, from_long[:-1][text[lead]])
    follow = np.flatnonzero(within % LEADERS)
    out[follow] = gallop(short[follow], long, out[follow - within[follow] % LEADERS])
    return out


def overlaps(place: np.ndarray, common: np.ndarray, from_short: np.ndarray, from_long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all linked tokens: a token of ``short`` overlaps those from the place after its predecessor's end to the place of its own."""
    n = np.diff(from_short)
    first = np.empty(len(place), np.int64)
    first[1:] = place[:-1] + common[:-1]
    first[from_short[:-1][n > 0]] = from_long[:-1][n > 0]
    count = place - first + 1
    own = np.repeat(np.arange(len(place)), count)
    return own, first[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)


class Aligned:
    """The tokens, common ends and links of a batch of texts."""

    def __init__(self, tok: Tokenizers, ids_a: np.ndarray, from_a: np.ndarray, ids_b: np.ndarray, from_b: np.ndarray):
        self.ids_a, self.from_a, self.ids_b, self.from_b = ids_a, from_a, ids_b, from_b
        ends_a, ends_b = np.cumsum(tok.len_a[self.ids_a]), np.cumsum(tok.len_b[self.ids_b])
        self.common_a, self.common_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
        n_a, n_b = np.diff(self.from_a), np.diff(self.from_b)
        links, text_of = [], []
        for a_drives in (True, False):
            mine = np.flatnonzero((n_a <= n_b) == a_drives)
            sides = (ends_a, self.from_a, self.common_a), (ends_b, self.from_b, self.common_b)
            (ends, start, common), (other, other_start, other_common) = sides if a_drives else sides[::-1]
            sizes = np.diff(start)[mine]
            index = np.repeat(start[:-1][mine], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            own_from = np.concatenate([[0], np.cumsum(sizes)])
            other_from = np.concatenate([other_start[:-1][mine], [0]])
            if not len(index):
                continue
            place = places(ends[index], other, own_from, other_from)
            hit = other[place] == ends[index]
            common[index[hit]] = True
            other_common[place[hit]] = True
            own, far = overlaps(place, hit, own_from, other_from)
            links.append((index[own], far) if a_drives else (far, index[own]))
            text_of.append(np.repeat(mine, sizes)[own])
        at_a, at_b = (np.concatenate([x[k] for x in links]) if links else np.empty(0, np.int64) for k in (0, 1))
        self.text = np.concatenate(text_of) if links else np.empty(0, np.int64)
        if len(links) > 1:  # text by text again
            order = np.argsort(self.text, kind="stable")
            at_a, at_b, self.text = at_a[order], at_b[order], self.text[order]
        self.pair = self.ids_a[at_a] << SHIFT | self.ids_b[at_b]
        self.b_id = self.ids_b[at_b]

    def n_groups(self) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(self.common_a)])
        return total[self.from_a[1:]] - total[self.from_a[:-1]]

    def groups(self, tok: Tokenizers) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each text."""
        group_a, group_b = (np.cumsum(c) - c for c in (self.common_a, self.common_b))
        b_before = np.concatenate([[0], np.flatnonzero(self.common_b) + 1])  # tokens of B in the groups before
        a_up_to = np.flatnonzero(self.common_a) + 1
        out = np.empty(len(self.ids_a) + len(self.ids_b), np.int64)
        out[np.arange(len(self.ids_a)) + b_before[group_a]] = self.ids_a + tok.width * self.common_a
        out[np.arange(len(self.ids_b)) + a_up_to[group_b]] = self.ids_b + tok.width * 2 * self.common_b
        said = tok.numerals
        ends = self.from_a + self.from_b
        return ["".join(map(said.__getitem__, out[s:e].tolist()))[:-1] for s, e in zip(ends, ends[1:])]


def _counted(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and how often each occurs."""
    pairs = np.sort(pairs)
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))[:len(pairs)]
    return pairs[first], np.diff(np.concatenate([first, [len(pairs)]]))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.argsort(pairs, kind="stable")
    pairs, n = pairs[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))[:len(pairs)]
    return pairs[first], np.add.reduceat(n, first) if len(first) else n


class Places:
    """Where each of some distinct numbers stands: found in the first slots from its own on."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.last, self.keys, self.at = np.uint64(64 - bits), (1 << bits) - 1, np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        number, slot = np.arange(len(keys)), self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several for one slot the last one stays
            self.at[slot[free]] = number[free]
            again = self.keys[slot] != keys
            keys, number, slot = keys[again], number[again], (slot[again] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, -1 if it is none of the keys."""
        slot = self._slot(values)
        going = np.flatnonzero((self.keys[slot] != values) & (self.keys[slot] >= 0))
        while len(going):
            slot[going] = (slot[going] + 1) & self.last
            going = going[(self.keys[slot[going]] != values[going]) & (self.keys[slot[going]] >= 0)]
        return np.where(self.keys[slot] == values, self.at[slot], -1)


def _ids(b: pa.RecordBatch, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """A column of token ids as (all ids, where each row's begin)."""
    c = b.column(name)
    first = np.frombuffer(c.buffers()[1], np.int32)[c.offset:c.offset + len(c) + 1].astype(np.int64)
    data = np.frombuffer(c.buffers()[2] or b"", np.uint8)[first[0]:first[-1]]
    return data.view(kind).astype(np.int64), (first - first[0]) // kind().nbytes


def _tokenizer(files: tuple[str, str, str]):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _loaded(*files)
        for b in batches(frames, TASK_BYTES):
            ids_a, from_a, ids_b, from_b = tok.encode(b.column("__text").to_pylist())
            cols = [pa.array([ids[s:e].tobytes() for s, e in zip(first, first[1:])], pa.binary()) for ids, first in ((ids_a.astype(tok.kind), from_a), (ids_b.astype(tok.kind), from_b))]
            rest = [c for c in b.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], *cols], [*rest, "__a", "__b"])
        tok.parts.clear()
        tok.runs.clear()

    return run


def tokenize(docs: DataFrame, text: str = "text", files: tuple[str, str, str] = (TOKENIZERS, A_FILE, B_FILE)) -> DataFrame:
    """``docs`` with ``text`` read as the ids of both tokenizers (__a, __b: numbers side by side, of 16 bits where they suffice)."""
    rest = [c for c in docs.columns if c not in ADDED]
    src = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__text"]
    return src.mapInArrow(_tokenizer(files), ", ".join([*fields, "__a binary, __b binary"]))


def _counter(files: tuple[str, str, str]):
    def out(parts: list) -> pa.RecordBatch:
        pairs, n = _merged(parts)
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, parts = _loaded(*files), []
        for b in batches(frames, TASK_BYTES):
            parts.append(_counted(Aligned(tok, *_ids(b, "__a", tok.kind), *_ids(b, "__b", tok.kind)).pair))
            if sum(len(p[0]) for p in parts) > 3_000_000:
                parts = [_merged(parts)]
                if len(parts[0][0]) > 1_500_000:
                    yield out(parts)
                    parts = []
        if parts:
            yield out(parts)

    return run


def count_pairs(tokens: DataFrame, files: tuple[str, str, str] = (TOKENIZERS, A_FILE, B_FILE)) -> DataFrame:
    """(pair, n): how many links of all rows hold each pair of ids, a << SHIFT | b."""
    return cut_lineage(tokens.select("__a", "__b").mapInArrow(_counter(files), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))


def _aligner(files: tuple[str, str, str], often):
    rare_type = pa.list_(pa.struct([("pair", pa.int64()), ("m", pa.int64())]))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _loaded(*files)
        pairs, counts, best = often.value
        places_of, counts = Places(pairs), np.append(counts, 0)
        highest = np.zeros(tok.width, np.int64)
        highest[best[0]] = best[1]
        for b in batches(frames, TASK_BYTES):
            al = Aligned(tok, *_ids(b, "__a", tok.kind), *_ids(b, "__b", tok.kind))
            rows = b.num_rows
            at = places_of.find(al.pair)
            known, count = at >= 0, counts[at]
            edge = np.searchsorted(al.text, np.arange(rows + 1))  # links stand text by text
            upto = [np.concatenate([[0], np.cumsum(x)]) for x in (known & (count == highest[al.b_id]), count)]
            wins, total = (u[edge[1:]] - u[edge[:-1]] for u in upto)
            # pairs whose counts the tasks have not, once for each text
            open_text, open_pair = al.text[~known], al.pair[~known]
            order = np.lexsort([open_pair, open_text])
            open_text, open_pair = open_text[order], open_pair[order]
            new = np.concatenate([[True], (open_text[1:] != open_text[:-1]) | (open_pair[1:] != open_pair[:-1])])[:len(order)]
            first = np.flatnonzero(new)
            m = np.diff(np.concatenate([first, [len(order)]]))
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(open_text[first], np.arange(rows + 1)), pa.int32()),
                                            pa.StructArray.from_arrays([pa.array(open_pair[first]), pa.array(m, pa.int64())], ["pair", "m"]))
            cols = [np.diff(al.from_a), np.diff(al.from_b), al.n_groups(), np.bincount(al.text, minlength=rows), wins, total]
            rest = [c for c in b.schema.names if c not in ("__a", "__b")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], *[pa.array(c, pa.int64()) for c in cols], pa.array(al.groups(tok), pa.string()), rare.cast(rare_type)],
                                             [*rest, *ADDED, "__rare"])

    return run


def align(docs: DataFrame, text: str = "text", files: tuple[str, str, str] = (TOKENIZERS, A_FILE, B_FILE), common: float = COMMON, groups: Column | None = None) -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links, n_best, count_sum and groups (``a1,a2|b1;a3|b2,b3``, or what the expression ``groups`` makes of it)."""
    spark = docs.sparkSession
    tokens, place = written(tokenize(docs, text, files), "tokens")
    counts = count_pairs(tokens, files)
    best = counts.groupBy(F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("b")).agg(F.max("n").alias("best"))
    of_b = best.toPandas()  # one number for each entry of B at most
    links = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    edge = max(1, common * links)
    often = counts.where(F.col("n") >= edge).toPandas().sort_values("pair")  # at most 1 / common rows
    sent = spark.sparkContext.broadcast((often["pair"].to_numpy(np.int64), often["n"].to_numpy(np.int64), (of_b["b"].to_numpy(np.int64), of_b["best"].to_numpy(np.int64))))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema if f.name not in ("__a", "__b")] + [f"{c} {t}" for c, t in ADDED.items()]
    rows = tokens.mapInArrow(_aligner(files, sent), ", ".join([*fields, "__rare array<struct<pair:bigint,m:bigint>>"]))
    rows = cut_lineage(rows.withColumns({"groups": F.col("groups") if groups is None else groups, "__row": F.monotonically_increasing_id()}))
    remove(spark, place)
    rare = rows.select("__row", F.inline("__rare")).join(counts.where(F.col("n") < edge), "pair")
    top = F.broadcast(best)  # as above
    rare = rare.join(top, F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)) == F.col("b"))
    sums = rare.groupBy("__row").agg(F.sum(F.col("m") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("n") == F.col("best"), F.col("m")).otherwise(F.lit(0))).alias("_best"))
    zero = F.lit(0).cast("long")
    return rows.drop("__rare").join(sums, "__row", "left").withColumns({
        "n_best": F.col("n_best") + F.coalesce("_best", zero), "count_sum": F.col("count_sum") + F.coalesce("_sum", zero)}).drop("__row", "_sum", "_best")


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    sha = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    out = align(read(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), groups=sha)
    return out.select("doc_id", *[c for c in ADDED if c != "groups"], F.col("groups").alias("groups_sha256"))
