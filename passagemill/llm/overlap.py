"""Same or near-same records across splits (problem 6).

Method: a compressed full-text index of evaluation shards.  The questions and
passages of a shard's evaluation records are indexed by their Burrows-Wheeler
transform, kept as runs with sampled suffixes; the training texts of the shard
are streamed through backward search, which gives the evaluation texts that hold
each run of words; runs merge to spans, the words they cover are counted, and a
pair whose counts could still mean four fifths is decided by the exact longest
common subsequence.  An evaluation text is indexed once in a shard, whatever the
number of records that have it.

Shards: questions are linked first, by sketches of the words of those that meet
in a bucket (:func:`candidates`); a shard is a question with the records of all
questions linked to it.  Buckets are prefix filters of growing depth: any two
matching texts share the first ``c`` of their common words, rarest first, and
these are among the first ``n - needed(n) + c`` of each.  A bucket with too many
pairs is split by one more word, again and again; a bucket that a further word
doesn't split is compared in blocks.  Shards with too many pairs are dealt by
their passages in the same way.  No pair is lost.

Defined results: rows with a missing question or passage, or without words,
match nothing; NULL and unknown split tags are no split; equal word sequences
are compared once and expanded at the end; an empty table gives no rows.  Words
are compared by 64-bit digests.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions.text import is_missing
from passagemill.llm.survivors import split_name
from passagemill.runtime import drop_settled, settle

SHARE = 0.8
#: A bucket with more pairs than this is split by a further word.
HOT_PAIRS = 20_000
#: Texts of one side of a block; buckets this deep aren't split any more but compared in blocks.
BLOCK, DEPTH = 2_048, 12
#: A shard with more record pairs than this is dealt by the passages of its records.
SHARD_PAIRS = 250_000
#: Pairs and hits held at a time.
HELD = 1_000_000

class _Digests(dict):
    """Eight bytes for each word; remembers the words it has seen."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > 500_000:
            self.clear()
        got = self[word] = hashlib.blake2b(word.encode(), digest_size=8).digest()
        return got


_DIGESTS = _Digests()


_RUN = re.compile(r"[^\W_]+")
#: Characters that join the parts of a word: apostrophes and invisible ones (fixed values).
_JOINING = dict.fromkeys(map(ord, "'’\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"))


def split_words(text: str) -> list[str]:
    """Lower-cased words without punctuation."""
    text = text.lower()
    if "'" in text or not text.isascii():
        text = text.translate(_JOINING)
    return _RUN.findall(text)


def word_ids(words: list[str]) -> bytes:
    """A 64-bit id for each word."""
    return b"".join([_DIGESTS[w] for w in words])


def common_words(a, b) -> int:
    """Length of the longest common subsequence, by bit-parallel addition."""
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def needed(n: int) -> int:
    """Least number of common words if the longer text has ``n``."""
    return -(-4 * n // 5)


def alike(a, b) -> bool:
    n, m = len(a), len(b)
    if min(n, m) < needed(max(n, m)) or not n:
        return False
    return common_words(a, b) >= needed(max(n, m))


class CompressedIndex:
    """Burrows-Wheeler index of integer texts: run-length ranks, one suffix in ``sample`` kept.

    Texts are sorted as wholes (each ends with a terminator of its own, which no
    pattern holds).  Of the transform only its runs are kept, by place and by
    symbol; a suffix that isn't kept is found by walking to one that is.
    """

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, sample: int = 8):
        sizes = lengths + 1
        count, n = len(lengths), int(sizes.sum())
        self.starts, self.n = np.cumsum(sizes) - sizes, n
        inside = np.ones(n, bool)
        inside[self.starts + sizes - 1] = False
        self.alphabet, ranks = np.unique(symbols, return_inverse=True)
        t = np.zeros(n, np.int64)
        t[inside], t[~inside] = ranks + count, np.arange(count)
        rank, k = t, 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[:-k] = rank[k:] + 1
            key = rank * (n + count + 1) + ahead
            order = np.argsort(key, kind="stable")
            step = np.ones(n, np.int64)
            step[1:] = key[order][1:] != key[order][:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(step) - 1
            if rank[order[-1]] == n - 1:
                break
            k *= 2
        symbol = np.maximum(t - count + 1, 0)  # 0 stands for every terminator
        last = symbol[order - 1]
        self.run_start = np.concatenate([[0], np.flatnonzero(np.diff(last)) + 1])
        self.run_symbol = last[self.run_start]
        runs = len(self.run_start)
        by = np.argsort(self.run_symbol, kind="stable")
        self.run_key = self.run_symbol[by] * runs + by
        self.before = np.concatenate([[0], np.cumsum(np.diff(np.append(self.run_start, n))[by])])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbol, minlength=len(self.alphabet) + 1))])
        self.first_run = np.searchsorted(self.run_key, np.arange(len(self.alphabet) + 2) * runs)
        begins = np.zeros(n, bool)
        begins[self.starts] = True
        kept = begins[order] | (order % sample == 0)
        self.kept_at, self.kept = np.flatnonzero(kept), order[kept]

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbol of each word, 0 if the index lacks it."""
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == words, at + 1, 0)

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each place."""
        runs = len(self.run_start)
        run = np.searchsorted(self.run_start, upto, side="right") - 1
        at = np.searchsorted(self.run_key, symbol * runs + run)
        part = np.where(self.run_symbol[run] == symbol, upto - self.run_start[run], 0)
        return self.before[at] - self.before[self.first_run[symbol]] + part

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """One step of backward search for many patterns at once."""
        base = self.first[symbol]
        return base + self.rank(symbol, lo), base + self.rank(symbol, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Place in the texts of each row of the suffix order."""
        out, open_, row, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows, 0
        while len(open_):
            at = np.minimum(np.searchsorted(self.kept_at, row), len(self.kept_at) - 1)
            hit = self.kept_at[at] == row
            out[open_[hit]] = self.kept[at[hit]] + steps
            open_, row, steps = open_[~hit], row[~hit], steps + 1
            symbol = self.run_symbol[np.searchsorted(self.run_start, row, side="right") - 1]
            row = self.first[symbol] + self.rank(symbol, row)
        return out

    def holders(self, lo: np.ndarray, hi: np.ndarray):
        """``(range, text)``: the texts that hold the pattern of each range, each once; ranges that repeat are located once."""
        ranges, which = np.unique(np.stack([lo, hi], 1), axis=0, return_inverse=True)
        sizes = ranges[:, 1] - ranges[:, 0]
        of = np.repeat(np.arange(len(ranges)), sizes)
        rows = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(ranges[:, 0], sizes)
        text = np.searchsorted(self.starts, self.locate(rows), side="right") - 1
        pairs = np.unique(of * len(self.starts) + text)
        return which.ravel(), pairs // len(self.starts), pairs % len(self.starts)

    def covered(self, words: np.ndarray, text_of: np.ndarray, length_of: np.ndarray):
        """``(streamed text, indexed text, words covered)``: how many words of a streamed text lie in spans that the indexed text holds.

        A span is a chain of runs of two words (of one, for texts of one word):
        that long at least is some run of every match.
        """
        s = self.symbols(words)
        known = s > 0
        two = np.zeros(len(s), bool)
        two[1:] = known[1:] & known[:-1] & (text_of[1:] == text_of[:-1])
        at, whole = np.flatnonzero(two), np.flatnonzero(known & (length_of == 1))
        lo, hi = self.extend(s[at - 1], self.first[s[at]], self.first[s[at] + 1])
        at = np.concatenate([at, whole])
        lo, hi = np.concatenate([lo, self.first[s[whole]]]), np.concatenate([hi, self.first[s[whole] + 1]])
        some = hi > lo
        at, lo, hi = at[some], lo[some], hi[some]
        none = np.zeros(0, np.int64)
        if not len(at):
            return none, none, none
        which, of, holder = self.holders(lo, hi)
        sizes = np.bincount(of, minlength=which.max() + 1)
        begin = np.cumsum(sizes) - sizes
        texts, width = len(self.starts), len(words) + 1
        out = []
        for lo_t, hi_t in _portions(at, text_of, sizes[which]):  # whole texts, as many hits at a time as fit in memory
            mine = slice(lo_t, hi_t)
            c = sizes[which[mine]]
            place = np.repeat(at[mine], c)
            who = holder[np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(begin[which[mine]], c)]
            pair = text_of[place].astype(np.int64) * texts + who
            longer = length_of[place] > 1
            span = np.unique(np.concatenate([pair * width + place, pair[longer] * width + place[longer] - 1]))
            out.append(np.unique(span // width, return_counts=True))
        pairs, counts = (np.concatenate(x) for x in zip(*out, strict=True))
        return pairs // texts, pairs % texts, counts


def _portions(at: np.ndarray, text_of: np.ndarray, hits: np.ndarray):
    """Bounds of runs of entries of whole texts with about HELD hits each; entries may come in two ordered parts."""
    ends = np.append(np.flatnonzero(np.diff(text_of[at])) + 1, len(at))
    upto = np.cumsum(hits)[ends - 1]
    cuts = np.searchsorted(upto, np.arange(HELD, upto[-1], HELD))
    bounds = np.unique(np.concatenate([[0], ends[cuts[cuts < len(ends)]], [len(at)]]))
    yield from zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)


def _flat(cells: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and the number of ids of each cell."""
    return np.frombuffer(b"".join(cells), np.uint64), np.array([len(x) for x in cells], np.int64) // 8


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _needed(n: np.ndarray) -> np.ndarray:
    return -(-4 * n // 5)


def match_texts(e_group, e_cells: list[bytes], t_group, t_cells: list[bytes]) -> set[tuple[int, int]]:
    """Numbers ``(evaluation text, training text)`` of the matching texts of equal group numbers."""
    (e_ids, m), (t_ids, n) = _flat(e_cells), _flat(t_cells)
    salt = [_mixed(np.repeat(np.asarray(g, np.uint64) + np.uint64(1), z)) for g, z in ((e_group, m), (t_group, n))]
    index = CompressedIndex(_mixed(e_ids ^ salt[0]), m)
    stream, ends = _mixed(t_ids ^ salt[1]), np.concatenate([[0], np.cumsum(n)])
    found = set()
    for k in range(0, len(n), 4096):
        mine = n[k : k + 4096]
        t, e, covered = index.covered(stream[ends[k] : ends[k + len(mine)]], np.repeat(np.arange(len(mine)), mine), np.repeat(mine, mine))
        long, short = np.maximum(mine[t], m[e]), np.minimum(mine[t], m[e])
        need = _needed(long)
        # of w common words in order, at most n + m - 2 w are runs of one word
        least = np.maximum(np.minimum(2, short), 3 * need - mine[t] - m[e])
        ok = (short >= need) & (covered >= least)
        for a, b in zip(e[ok].tolist(), (t[ok] + k).tolist(), strict=True):
            if e_cells[a] == t_cells[b] or alike(np.frombuffer(e_cells[a], np.uint64).tolist(), np.frombuffer(t_cells[b], np.uint64).tolist()):
                found.add((a, b))
    return found


def match_shards(shard: list[int], side: list[int], cls: list[int], q: list[bytes], s: list[bytes]) -> list[tuple[int, int]]:
    """``(evaluation class, training class)`` of the matching records of one task's shards."""
    sides: list[set] = [set(), set()]
    for h, k in zip(shard, side, strict=True):
        sides[k].add(h)
    number = {h: i for i, h in enumerate(sorted(sides[0] & sides[1]))}
    if not number:
        return []
    texts: list[dict] = [{}, {}]  # of each side: (group, words) -> number; a text stands in the index once for each shard
    records: list[dict] = [{}, {}]  # (question's text, passage's text) -> classes
    for h, k, c, a, b in zip(shard, side, cls, q, s, strict=True):
        if h in number:
            g, of = 2 * number[h], texts[k]
            key = of.setdefault((g, a), len(of)), of.setdefault((g + 1, b), len(of))
            records[k].setdefault(key, []).append(c)
    alike_texts = match_texts([x[0] for x in texts[0]], [x[1] for x in texts[0]], [x[0] for x in texts[1]], [x[1] for x in texts[1]])
    partners: dict[int, list[int]] = {}
    for a, b in alike_texts:
        partners.setdefault(a, []).append(b)
    by_passage: dict[int, list] = {}
    for key in records[1]:
        by_passage.setdefault(key[1], []).append(key)
    out = []
    for (a, b), mine in records[0].items():
        for passage in partners.get(b, ()):
            for key in by_passage.get(passage, ()):
                if (a, key[0]) in alike_texts:
                    out += [(e, t) for e in mine for t in records[1][key]]
    return out


_ROWS = "pair_id long, split string, train byte, qk binary, sk binary, q binary, s binary"


def records(pairs: DataFrame) -> DataFrame:
    """``(pair_id, split, train, qk, sk, q, s)``: word ids of question and passage, and their digests.

    A text's words are given with its first record in a task, NULL with the others.
    """

    def read(it):
        seen: set[bytes] = set()
        for b in it:
            rows = []
            for rid, split, q, s in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                qw, sw = word_ids(split_words(q)), word_ids(split_words(s))
                if not qw or not sw:
                    continue
                train = int(split == "train")
                keys = hashlib.md5(qw).digest(), hashlib.md5(sw).digest()
                if len(seen) > 1_000_000:
                    seen.clear()
                new = []
                for kind, key, words in ((b"q", keys[0], qw), (b"s", keys[1], sw)):
                    mark = kind + key + bytes([train])
                    new.append(None if mark in seen else words)
                    seen.add(mark)
                rows.append((rid, split, train, *keys, *new))
            cols = zip(*rows, strict=True) if rows else [[]] * 7
            types = pa.int64(), pa.string(), pa.int8(), pa.binary(), pa.binary(), pa.binary(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["pair_id", "split", "train", "qk", "sk", "q", "s"])

    split = split_name(F.col("_split_tag"))
    q, s = F.col("question").cast("string"), F.col("source").cast("string")
    rows = pairs.where(split.isNotNull() & F.col("pair_id").isNotNull() & ~is_missing(q) & ~is_missing(s))
    return rows.select(F.col("pair_id").cast("long").alias("pair_id"), split.alias("split"), q.alias("q"), s.alias("s")).mapInArrow(read, _ROWS)


def frequent_ids(texts: DataFrame, column: str, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids of the words that occur in more than ``least`` texts, and their counts. Of ``n`` texts at most the words of one text times ``n / least`` are so frequent."""

    def count(it):
        held = None
        for b in it:
            ids, sizes = _flat(b.column(0).to_pylist())
            text_of = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((ids, text_of))
            ids, text_of = ids[order], text_of[order]
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (text_of[1:] != text_of[:-1])
            u, n = np.unique(ids[new], return_counts=True)
            if held is not None:
                u, at = np.unique(np.concatenate([held[0], u]), return_inverse=True)
                n = np.bincount(at, np.concatenate([held[1], n])).astype(np.int64)
            held = u, n
            if len(u) > 500_000:
                yield _counts(*held)
                held = None
        if held is not None:
            yield _counts(*held)

    got = texts.select(column).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > least).collect()
    words, counts = np.array([r["word"] for r in got], np.int64).view(np.uint64), np.array([r["n"] for r in got], np.int64)
    order = np.argsort(words)
    return words[order], counts[order]


def _counts(u, n):
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["word", "n"])


def heads(cells: list[bytes], frequent: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The words of each text, rarest first and repeats numbered, as far as buckets of any depth need them."""
    ids, sizes = _flat(cells)
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    df = np.zeros(len(ids), np.int64)
    if len(frequent):
        nearest = np.minimum(np.searchsorted(frequent, ids), len(frequent) - 1)
        df = np.where(frequent[nearest] == ids, counts[nearest], 0)
    order = np.lexsort((ids, df, text_of))
    w, at = ids[order], np.arange(len(ids))
    new = np.ones(len(ids), bool)
    new[1:] = (w[1:] != w[:-1]) | (text_of[1:] != text_of[:-1])
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    key = _mixed(w + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ends = np.cumsum(sizes)
    return [key[e - n : e - n + min(n, n - needed(n) + DEPTH)].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def sketches(cells: list[bytes]) -> np.ndarray:
    """256 bits for each text: a bit that one has and another lacks stands for a word that they don't share."""
    ids, sizes = _flat(cells)
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    bits = np.zeros((len(sizes), 4), np.uint64)
    np.bitwise_or.at(bits, (text_of, (ids >> np.uint64(6)) & np.uint64(3)), np.uint64(1) << (ids & np.uint64(63)))
    return bits.view(np.int64)


_NODE = "node long, n int, head binary, w0 long, w1 long, w2 long, w3 long"


def prepared(texts: DataFrame) -> DataFrame:
    """``(node, n, head, w0, w1, w2, w3)`` from ``(node, words)``."""
    # at most the words of one text times a thousand are so frequent
    frequent = texts.sparkSession.sparkContext.broadcast(frequent_ids(texts, "words", max(8, texts.count() / 1000)))

    def prepare(it):
        for b in it:
            cells = b.column(1).to_pylist()
            bits = sketches(cells)
            n = pa.array(np.array([len(c) // 8 for c in cells], np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(heads(cells, *frequent.value), pa.binary()), *(pa.array(bits[:, i].copy()) for i in range(4))], names=["node", "n", "head", "w0", "w1", "w2", "w3"])

    return settle(texts.select("node", "words").mapInArrow(prepare, _NODE))


def _deeper(depth: int):
    """Entries one word deeper than ``depth``: ``(key, last, side, node, final, above)``."""

    def step(it):
        for b in it:
            if not b.num_rows:
                continue
            key, last, above, node, side, n = (np.asarray(b.column(i)) for i in range(6))
            flat, have = _flat(b.column(6).to_pylist())
            n = n.astype(np.int64)
            upto = np.minimum(n - _needed(n) + depth + 1, have)
            count = np.maximum(upto - last - 1, 0)
            row = np.repeat(np.arange(len(n)), count)
            at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + last[row] + 1
            word = flat[(np.cumsum(have) - have)[row] + at]
            grown = _mixed(key[row].view(np.uint64) * np.uint64(0xD1342543DE82EF95) + word).view(np.int64)
            final = (_needed(n) <= depth + 1)[row]
            for k in range(0, len(row), 65536):
                z = slice(k, k + 65536)
                yield pa.RecordBatch.from_arrays([pa.array(grown[z]), pa.array(at[z].astype(np.int32)), pa.array(side[row[z]]), pa.array(node[row[z]]), pa.array(final[z].astype(np.int8)), pa.array(above[row[z]])], names=["key", "last", "side", "node", "final", "above"])

    return step


_ENTRY = "key long, last int, side byte, node long, final byte, above long"


def _compare(it):
    """Pairs of a task's blocks that lengths and sketches allow."""
    bs = [b for b in it if b.num_rows]
    if not bs:
        return
    t = pa.Table.from_batches(bs).sort_by("block")
    block, side, node, lone, n = (t[c].to_numpy() for c in ("block", "side", "node", "lone", "n"))
    bits = np.stack([t[f"w{i}"].to_numpy() for i in range(4)], 1).view(np.uint64)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1])
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(block))))
    n = n.astype(np.int64)
    fold, slack = np.bitwise_or.reduce(bits, axis=1), (n - _needed(n)).astype(np.uint8 if n.max() < 1000 else np.int64)
    e, tr = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    times_of = np.bincount(group[tr], minlength=len(starts))[group[e]]
    first = np.searchsorted(group[tr], group[e], side="left")
    fold_t, slack_t = fold[tr], slack[tr]
    upto = np.cumsum(times_of)
    for part in np.split(np.arange(len(e)), np.searchsorted(upto, np.arange(HELD, upto[-1] if len(e) else 0, HELD))):
        times, mine = times_of[part], e[part]
        right = np.repeat(first[part] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        a, b = np.repeat(fold[mine], times), fold_t[right]
        # the bits of all four quarters together reject most pairs of short texts
        near = np.flatnonzero((np.bitwise_count(a & ~b) <= np.repeat(slack[mine], times)) & (np.bitwise_count(b & ~a) <= slack_t[right]))
        left, right = np.repeat(mine, times)[near], tr[right[near]]
        # a pair of which neither is final here is found one word deeper
        ok = (node[left] != node[right]) & ((lone[left] | lone[right]) > 0) & (5 * np.minimum(n[left], n[right]) >= 4 * np.maximum(n[left], n[right]))
        left, right = left[ok], right[ok]
        need = _needed(np.maximum(n[left], n[right]))
        for i in range(4):  # words lacking on either side, a quarter of the bits at a time
            both = bits[left, i] & bits[right, i]
            lack = np.bitwise_count(bits[left, i] & ~both).astype(np.int64), np.bitwise_count(bits[right, i] & ~both).astype(np.int64)
            missing = lack if i == 0 else (missing[0] + lack[0], missing[1] + lack[1])
            ok = (missing[0] <= n[left] - need) & (missing[1] <= n[right] - need)
            left, right, need, missing = left[ok], right[ok], need[ok], (missing[0][ok], missing[1][ok])
        if len(left):
            u = np.unique(np.stack([node[left], node[right]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(u[0]), pa.array(u[1])], names=["e", "t"])


def candidates(seats: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(e, t)``: nodes of side 0 and 1 of one base whose texts could match; every pair that matches is among them.

    ``seats``: ``(base, side, node, n, head)``, one row for each side and base of
    a node; ``nodes``: see :func:`prepared`.  Buckets of equal first common words
    are split by one more word while they have more than ``HOT_PAIRS`` pairs and
    a word still splits them.
    """
    spark = nodes.sparkSession
    parents = seats.select(F.col("base").alias("key"), F.lit(-1).alias("last"), F.lit(2**62).alias("above"), "node", "side", "n", "head")
    levels = []
    for depth in range(DEPTH):
        entries = parents.mapInArrow(_deeper(depth), _ENTRY)
        loads = entries.groupBy("key").agg(F.sum(1 - F.col("side")).alias("e"), F.sum("side").alias("t"), F.sum("final").alias("finals"), F.max("above").alias("above"))
        pairs = F.col("e") * F.col("t")
        # of a bucket nothing splits any more all pairs are compared, of another hot one those with a final text
        whole = (pairs <= HOT_PAIRS) | (2 * pairs > F.col("above")) | F.lit(depth + 1 == DEPTH)
        state = loads.where("e > 0 and t > 0").select("key", "e", "t", whole.alias("whole"), (F.col("finals") > 0).alias("some"))
        level = settle(entries.drop("above").join(state, "key"))
        levels.append(level)
        split = level.where("not whole and final = 0")
        if split.isEmpty():
            break
        parents = split.select("key", "last", (F.col("e") * F.col("t")).alias("above"), "node", "side").join(nodes.select("node", "n", "head"), "node").select("key", "last", "above", "node", "side", "n", "head")
    met = reduce(DataFrame.unionAll, [x.where("whole or some").select("key", "side", "node", "e", "t", (F.col("whole") | (F.col("final") > 0)).cast("byte").alias("lone")) for x in levels])
    # a bucket of more than BLOCK texts of a side is met block by block
    hot = F.col("e") * F.col("t") > HOT_PAIRS
    mine, others = (F.when(hot, F.ceil(F.when(F.col("side") == k, F.col("e")).otherwise(F.col("t")) / BLOCK)).otherwise(1) for k in (0, 1))
    own, other = F.pmod(F.xxhash64("node"), mine), F.explode(F.sequence(F.lit(0).cast("long"), others.cast("long") - 1))
    spread = met.select("key", "side", "node", "lone", own.alias("own"), other.alias("other"))
    block = F.xxhash64("key", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")))
    placed = spread.select(block.alias("block"), "side", "node", "lone").join(nodes.drop("head"), "node").select("block", "side", "node", "lone", "n", "w0", "w1", "w2", "w3")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(tasks, sum(x.count() for x in levels) // 250_000)
    out = settle(placed.repartition(tasks, "block").mapInArrow(_compare, "e long, t long").distinct())
    for x in levels:
        drop_settled(x)
    return out


def question_links(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(es, ts)``, numbers of the questions of evaluation and of training records that could match, and ``(qk, qid, q)``."""
    kinds = rows.where("q is not null").groupBy("qk").agg(F.first("q").alias("q"), F.min("pair_id").alias("qid"), F.max("train").alias("train"), F.max(1 - F.col("train")).alias("eval"))
    questions = settle(kinds)
    nodes = prepared(questions.select(F.col("qid").alias("node"), F.col("q").alias("words")))
    sides = F.filter(F.array(F.when(F.col("eval") == 1, F.lit(0).cast("byte")), F.when(F.col("train") == 1, F.lit(1).cast("byte"))), lambda x: x.isNotNull())
    seats = questions.select(F.col("qid").alias("node"), F.explode(sides).alias("side")).join(nodes, "node").select(F.lit(0).cast("long").alias("base"), "side", "node", "n", "head")
    near = candidates(seats, nodes).select(F.col("e").alias("es"), F.col("t").alias("ts"))
    same = questions.where("train = 1 and eval = 1").select(F.col("qid").alias("es"), F.col("qid").alias("ts"))
    return same.unionByName(near), questions.select("qk", "qid", "q")


def class_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(e, t)`` of matching classes and ``(pair_id, split, train, cls)`` of every record; a class is one word sequence on one side."""
    spark = rows.sparkSession
    found, questions = question_links(rows)
    links = settle(found)
    # only records of questions with a partner on the other side can match
    ends = links.select(F.col("es").alias("qid"), F.lit(0).cast("byte").alias("train")).union(links.select(F.col("ts"), F.lit(1).cast("byte"))).distinct()
    named = rows.select("pair_id", "split", "train", "sk", "qk").join(questions.select("qk", "qid"), "qk").select("pair_id", "split", "train", "qid", "sk")
    live = settle(named.join(ends, ["qid", "train"]))
    classes = settle(live.groupBy("train", "qid", "sk").agg(F.min("pair_id").alias("cls")))
    members = live.join(classes, ["train", "qid", "sk"]).select("pair_id", "split", "train", "cls")
    # a link is followed in the shard of its larger question, so the records of a much-used question stay where they are
    sizes = classes.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    sized = links.join(sizes.select(F.col("qid").alias("es"), F.col("n").alias("en")), "es").join(sizes.select(F.col("qid").alias("ts"), F.col("n").alias("tn")), "ts")
    routed = sized.select("es", "ts", F.when(F.struct("en", "es") >= F.struct("tn", "ts"), F.col("es")).otherwise(F.col("ts")).alias("shard"))
    routes = settle(routed.select("shard", F.col("es").alias("qid"), F.lit(0).cast("byte").alias("train")).union(routed.select("shard", F.col("ts"), F.lit(1).cast("byte"))).distinct())
    entries = classes.join(routes, ["qid", "train"]).select("shard", F.col("train").alias("side"), "cls")
    loads = settle(entries.groupBy("shard").agg(F.sum(1 - F.col("side")).alias("e"), F.sum("side").alias("t")).where("e > 0 and t > 0"))
    passages = rows.where("s is not null").select("sk", "s").join(classes.select("sk"), "sk", "left_semi").groupBy("sk").agg(F.first("s").alias("s"))
    bodies = settle(classes.join(passages, "sk").join(questions.select("qid", "q"), "qid").select("cls", "q", "s"))
    hot = loads.where(F.col("e") * F.col("t") > SHARD_PAIRS).select("shard")
    cold = entries.join(loads.where(F.col("e") * F.col("t") <= SHARD_PAIRS).select("shard"), "shard", "left_semi")
    total = loads.agg(F.sum(F.col("e") + F.col("t"))).first()[0] or 0
    if not hot.isEmpty():
        dealt = settle(entries.join(hot, "shard", "left_semi").select(F.col("shard").alias("base"), F.col("cls").alias("node"), "side"))
        nodes = prepared(settle(bodies.join(dealt.select(F.col("node").alias("cls")), "cls", "left_semi").select(F.col("cls").alias("node"), F.col("s").alias("words"))))
        near = candidates(dealt.join(nodes, "node").select("base", "side", "node", "n", "head"), nodes)
        # records with one passage meet by it, others by the buckets of their words; each evaluation record is then a shard of its own
        of = entries.join(hot, "shard", "left_semi").join(classes.select("cls", "sk"), "cls")
        same = of.where("side = 0").select("shard", "sk", F.col("cls").alias("e")).join(of.where("side = 1").select("shard", "sk", F.col("cls").alias("t")), ["shard", "sk"]).select("e", "t")
        near = settle(near.unionByName(same).distinct())
        own = F.xxhash64(F.lit("record"), "e").alias("shard")
        cold = cold.unionByName(near.select(own, F.lit(0).cast("byte").alias("side"), F.col("e").alias("cls")).distinct()).unionByName(near.select(own, F.lit(1).cast("byte").alias("side"), F.col("t").alias("cls")))
        total += 2 * near.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 40_000)

    def match(it):
        bs = [b for b in it if b.num_rows]
        if not bs:
            return
        got = match_shards(*(pa.Table.from_batches(bs)[c].to_pylist() for c in ("shard", "side", "cls", "q", "s")))
        if got:
            e, t = zip(*got, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()), pa.array(t, pa.int64())], names=["e", "t"])

    whole = cold.join(bodies, "cls").select("shard", "side", "cls", "q", "s")
    return whole.repartition(tasks, "shard").mapInArrow(match, "e long, t long").distinct(), members


def overlaps(pairs: DataFrame) -> DataFrame:
    """``(eval_id, split, train_id)`` for every evaluation record and every training record it matches."""
    rows = settle(records(pairs))
    hits, members = class_pairs(rows)
    members, hits = settle(members), settle(hits)
    e = members.where("train = 0").select(F.col("cls").alias("e"), F.col("pair_id").alias("eval_id"), "split")
    t = members.where("train = 1").select(F.col("cls").alias("t"), F.col("pair_id").alias("train_id"))
    return hits.join(e, "e").join(t, "t").select("eval_id", "split", "train_id")


def found(pairs: DataFrame) -> DataFrame:
    o = overlaps(pairs)
    return o.select(F.least("eval_id", "train_id").alias("pair_id_a"), F.greatest("eval_id", "train_id").alias("pair_id_b"))


def report(pairs: DataFrame) -> DataFrame:
    """Evaluation records with a match in training, and matching pairs, per split and source id."""
    o = overlaps(pairs)
    per = o.groupBy("eval_id", "split").agg(F.count(F.lit(1)).alias("n"))
    source: Column = F.when(F.col("source_id") >= 0, F.col("source_id"))
    named = per.join(pairs.select(F.col("pair_id").alias("eval_id"), source.alias("source_id")), "eval_id")
    return named.groupBy("split", "source_id").agg(F.count(F.lit(1)).alias("leaked_rows"), F.sum("n").alias("pairs"))
