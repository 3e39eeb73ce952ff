"""Fuzzy passages that documents share, by collinear chains of common k-mers.

Seeds are runs of K words, of which a hash keeps one in KEEP, and runs of LONG words, thinned to the least hash of each WINDOW of
them, so that two texts with MIN_WORDS words in common have a long seed in common. A seed's occurrence is tied to the first
document that has it and to the one before it, not to all others: links grow with the seeds, not with their square. The seeds
that a document shares with another are merged along diagonals and chained by a Fenwick tree over the other's positions;
chains are aligned word by word, between their seeds and outwards.

What those ties could miss is looked for exactly: where a long seed has more places before than it is tied to, and no passage found covers all
runs of MIN_WORDS words about it, those runs themselves are tied to the first document that has them. So every run of MIN_WORDS
words that an earlier document has is covered by a passage (where a document repeats something at shorter intervals: as often in a row
as the other has it). Then every seed of either kind that has more places before than it is tied to, and that no passage found holds, is
compared with all its places before by the words about both (_untied): where enough of them are in common for a passage, the two are aligned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, group_of_equal, map_in_arrow, running_totals, slices, write_table

#: A passage: its words, its share of words in common.
MIN_WORDS, SIMILARITY = 50, 0.8
#: Short seeds; long ones, and their windows.
K, KEEP, LONG = 4, 5, 16
WINDOW = MIN_WORDS - LONG + 1
#: A chain: the largest gap in words, the cost of a word of gap, the words that its seeds hold at least, and the words about it in which its ends are looked for.
MAX_GAP, GAP_COST, LEAST_WORDS, MARGIN = 40, 0.05, 2 * K - 1, 52
#: Seeds of one diagonal become one anchor over so many words. Pieces of sources start and end at multiples of GRID words, so that many chains ask for the same.
MERGE, GRID, SALTS = 16, 64, 16
#: Of MIN_WORDS words in a row a passage may lack LACK; the other text may have SPARE more, so these words reach so far beyond a seed. Places of a seed are compared in squares of about BLOCK by BLOCK.
LACK, SPARE = MIN_WORDS - round(MIN_WORDS * SIMILARITY), int(MIN_WORDS / SIMILARITY) - MIN_WORDS
REACH, BLOCK = MIN_WORDS - K + SPARE, 1 << 13
#: Documents that are asked for are told by so many numbers.
BUCKETS = 1 << 18
#: Ties that leave out places before: a seed has two at most, one in its first document and one in that before.
UNTIED = "(before > 2 or before = 2 and p_doc <=> f_doc)"
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(p: int, n: int) -> np.ndarray:
    out = np.full(n, p, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Powers of _P and of its inverse, as many as the longest text had characters.
_tables = [_powers(int(_P), 1 << 16), _powers(pow(int(_P), -1, 1 << 64), 1 << 16)]


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word (anything between ASCII white space, A-Z folded) of a text, in characters."""
    code = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(_tables[0]) < len(code):
        _tables[:] = _powers(int(_P), 2 * len(code)), _powers(pow(int(_P), -1, 1 << 64), 2 * len(code))
    code = code + ((code - 65 < 26) * np.uint8(32))
    solid = np.ones(len(code) + 2, bool)
    solid[0] = solid[-1] = False
    solid[1:-1] = (code != 32) & (code - 9 > 4)
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * _tables[0][: len(code)], out=total[1:])
    return start, end, _mix((total[end] - total[start]) * _tables[1][start])


def grams(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; none, if there are fewer. (A text has no more words than characters, so the tables are long enough.)"""
    n = max(0, len(word) - k + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(word * _tables[0][: len(word)])))
    return _mix((total[k : k + n] - total[:n]) * _tables[1][:n])


def numbered(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """`code`, the second of two equal ones that start less than MIN_WORDS words apart made another, the third of three yet another, and so on.

    So repeats in a row (one word or line again and again) meet as many repeats elsewhere side by side, and not each of them the first.
    """
    order = np.argsort(code, kind="stable")  # the places ascend
    equal = code[order[1:]] == code[order[:-1]]
    if not equal.any():
        return code
    near = np.concatenate(([False], equal & (np.diff(at[order]) < MIN_WORDS)))
    row = np.arange(len(code))
    nth = row - np.maximum.accumulate(np.where(near, 0, row))
    out = code.copy()
    again = order[nth > 0]
    out[again] = _mix(code[again] + nth[nth > 0].astype(np.uint64) * _P)
    return out


def _least(code: np.ndarray, width: int) -> np.ndarray:
    """Of each `width` values in a row the place of the least, of equal ones the first."""
    at, size = np.arange(len(code)), 1
    while size < width:
        step = min(size, width - size)
        a, b = at[:-step], at[step:]
        at = np.where(code[b] < code[a], b, a)
        size += step
    return at


def least_of_windows(code: np.ndarray, width: int) -> np.ndarray:
    """The places of the least (of equal ones the first) of each `width` values in a row, once each."""
    at = _least(code, width)
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def seeds_of_all(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, word) of all places of the seeds of some texts, numbered(). Hashes of long seeds are odd. Texts too short for a passage have none."""
    start, _, word = words_of("\n".join(texts))
    if len(word) < MIN_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    first = np.searchsorted(start, np.cumsum([0, *[len(t) + 1 for t in texts]]))
    count = np.diff(first)
    text = np.repeat(np.arange(len(texts)), count)
    rest = first[text + 1] - np.arange(len(word))  # words to the text's end
    short, long = grams(word, K), grams(word, LONG)
    at = np.flatnonzero((short % np.uint64(KEEP) == 0) & (rest[: len(short)] >= K) & (count[text[: len(short)]] >= MIN_WORDS))
    far = _least(long, WINDOW)
    far = far[rest[: len(far)] >= MIN_WORDS]
    far = far[np.concatenate((np.ones(min(1, len(far)), bool), far[1:] != far[:-1]))]
    one, apart = np.uint64(1), lambda x: x + text[x] * MIN_WORDS  # places in other texts are never near
    code = np.concatenate((numbered(short[at], apart(at)) & ~one, numbered(long[far], apart(far)) | one)).view(np.int64)
    at = np.concatenate((at, far))
    return code, text[at], (at - first[text[at]]).astype(np.int32)


def seeds_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word) of all places of the seeds of a text, as in seeds_of_all."""
    code, _, word = seeds_of_all([text])
    return code, word


class Fenwick:
    """Prefix maxima of (score, anchor)."""

    def __init__(self, n: int):
        self.n, self.best = n, [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i <= self.n:
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def top(self, i: int) -> tuple[float, int]:
        """Over the places before i."""
        out = (-1e18, -1)
        while i > 0:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def merge_diagonals(pos: np.ndarray, other: np.ndarray, length: np.ndarray) -> list[list[int]]:
    """Anchors [start, other start, length, seeds], by start: seeds that follow each other on one diagonal within MERGE words become one."""
    order = np.lexsort((pos, pos - other))
    pos, other, length = pos[order], other[order], length[order]
    new = np.ones(len(pos), bool)
    new[1:] = (np.diff(pos - other) != 0) | (pos[1:] - (pos[:-1] + length[:-1]) > MERGE)
    first = np.flatnonzero(new)
    again = np.concatenate(([False], (np.diff(pos) == 0) & ~new[1:]))  # a short and a long seed at one place are one
    out = np.stack((pos[first], other[first], np.maximum.reduceat(pos + length, first) - pos[first], np.add.reduceat((~again).astype(int), first)), 1)
    return out[np.lexsort((out[:, 1], out[:, 0]))].tolist()


def _ends(a: list[int]) -> tuple[int, int]:
    """Where the next anchor may start: as much as a seed less a word may overlap."""
    size = max(1, a[2] - K + 1)
    return a[0] + size, a[1] + size


def chain_scores(anchors: list[list[int]]) -> tuple[list[float], list[int]]:
    """(score, anchor before, or -1) of the best chain that ends in each of the `anchors` (sorted by start).

    A chain's score is the sum of its anchors' lengths less GAP_COST for each word between them, in either text. One pass: anchors enter the tree,
    which is over their ends in the other text, as soon as a start passes their end.
    """
    n = len(anchors)
    ends = [_ends(a) for a in anchors]
    places = sorted({e[1] for e in ends})
    entering = sorted(range(n), key=lambda t: ends[t][0])
    tree, score, back, k = Fenwick(len(places)), [0.0] * n, [-1] * n, 0
    rank = {v: i for i, v in enumerate(places)}
    starts = np.searchsorted(places, [a[1] for a in anchors], "right").tolist()
    for i, (a, b, size, _) in enumerate(anchors):
        while k < n and ends[entering[k]][0] <= a:
            t = entering[k]
            tree.put(rank[ends[t][1]], (score[t] + GAP_COST * (ends[t][0] + ends[t][1]), t))
            k += 1
        value, prior = tree.top(starts[i])
        gain = value - GAP_COST * (a + b)
        score[i], back[i] = (size + gain, prior) if prior >= 0 and gain > 0 else (float(size), -1)
    return score, back


def chain_members(anchors: list[list[int]]) -> list[list[list[int]]]:
    """The anchors dealt to chains: the best first, each taking what those before it have left. Cut where a gap is wider than MAX_GAP."""
    score, back = chain_scores(anchors)
    gone, found = [False] * len(anchors), []
    for at in sorted(range(len(anchors)), key=lambda t: (-score[t], t)):
        own: list[list[int]] = []
        while at >= 0 and not gone[at]:
            gone[at] = True
            if own and max(own[-1][i] - _ends(anchors[at])[i] for i in (0, 1)) > MAX_GAP:
                found.append(own[::-1])
                own = []
            own.append(anchors[at])
            at = back[at]
        if own:
            found.append(own[::-1])
    return found


def _common(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Places of a longest common subsequence, by bit-parallel rows: a bit of a row that is 0 adds one to the length."""
    masks: dict[int, int] = {}
    for j, y in enumerate(b):
        masks[y] = masks.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        u = row & masks.get(x, 0)
        row = (row + u | row - u) & full
        rows.append(row)
    i, j, at_a, at_b = len(a), len(b), [], []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not (i and not rows[i - 1] >> (j - 1) & 1):
                j -= 1
                at_a.append(i)
                at_b.append(j)
    return at_a[::-1], at_b[::-1]


def _runs_of_seeds(a: np.ndarray, b: np.ndarray, fixed: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(place in a, place in b, words) of the seeds whose words are equal, in order; those that follow each other on one diagonal, with equal words between, are one."""
    out: list[tuple[int, int, int]] = []
    if not fixed:
        return out
    p, q = np.array(sorted(fixed)).T
    fits = (p + K <= len(a)) & (q + K <= len(b))
    cut = np.flatnonzero(np.concatenate(([True], np.diff(p - q) != 0, [True])))
    for lo, hi in zip(cut[:-1], cut[1:]):
        own = p[lo:hi][fits[lo:hi]]
        if not len(own):
            continue
        start, shift = int(own[0]), int(p[lo] - q[lo])
        stop = int(own[-1]) + K
        apart = np.concatenate(([0], np.cumsum(a[start:stop] != b[start - shift : stop - shift])))
        own = own[apart[own - start + K] == apart[own - start]]
        if len(own):
            first = np.concatenate(([True], apart[own[1:] - start] != apart[own[:-1] - start]))
            ends = np.append(np.flatnonzero(first)[1:], len(own)) - 1
            out += [(int(x), int(x) - shift, int(z) + K - int(x)) for x, z in zip(own[first], own[ends])]
    return out


def matches(a: np.ndarray, b: np.ndarray, fixed: list[tuple[int, int]] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Word places of an alignment that keeps the `fixed` seeds (places in a and b), with most words in common between and beyond them."""
    out_a, out_b, i, j = [], [], 0, 0

    def fill(p: int, q: int) -> None:
        """From i, j to p, q."""
        n = min(p - i, q - j)
        if not n:
            return
        same = a[i : i + n] == b[j : j + n]
        head = n if same.all() else int(same.argmin())
        same = a[p - n + head : p][::-1] == b[q - n + head : q][::-1]
        tail = len(same) if same.all() else int(same.argmin())
        x, y = _common(a[i + head : p - tail].tolist(), b[j + head : q - tail].tolist()) if min(p - i, q - j) > head + tail else ([], [])
        out_a.extend((np.arange(i, i + head), np.array(x, np.int64) + i + head, np.arange(p - tail, p)))
        out_b.extend((np.arange(j, j + head), np.array(y, np.int64) + j + head, np.arange(q - tail, q)))

    for p, q, n in _runs_of_seeds(a, b, fixed):
        used = max(i - p, j - q, 0)
        p, q, n = p + used, q + used, n - used
        if n <= 0:
            continue
        fill(p, q)
        out_a.append(np.arange(p, p + n))
        out_b.append(np.arange(q, q + n))
        i, j = p + n, q + n
    fill(len(a), len(b))
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def stretches(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) match of every stretch that has MIN_WORDS and SIMILARITY; x and y are the places of the matches.

    The best-scoring stretch is taken (words in common count, words apart cost so much that SIMILARITY is 0; of equal ones the
    longest), or where that is too short, the longest that scores 0. What lies on both sides of it is looked at again.
    """
    gap = np.maximum(np.diff(x), np.diff(y)) - 1
    gain = np.concatenate(([1.0], 1.0 - gap / (1 - SIMILARITY) * SIMILARITY))
    out, parts, eps = [], [(0, len(x))], 1e-6
    while parts:
        l, r = parts.pop()
        if r - l < MIN_WORDS * SIMILARITY:
            continue
        total = np.cumsum(gain[l:r])
        base = total - 1.0  # what precedes a stretch that starts at i
        low = np.minimum.accumulate(base)
        best = total - low
        hi = int(np.flatnonzero(best >= best.max() - eps)[-1])
        lo = int(np.flatnonzero(base[: hi + 1] <= low[hi] + eps)[0])
        xs, ys = x[l:r], y[l:r]
        if min(xs[hi] - xs[lo], ys[hi] - ys[lo]) + 1 < MIN_WORDS:
            first = np.searchsorted(-low, -(total + eps))
            size = np.minimum(xs - xs[first], ys - ys[first]) + 1
            hi = int(size.argmax())
            lo = int(first[hi])
            if size[hi] < MIN_WORDS:
                continue
        out.append((l + lo, l + hi))
        parts += [(l, l + lo), (l + hi + 1, r)]
    return sorted(out)


def align(a: str, b: str, fixed: list[tuple[int, int]] = ()) -> list[tuple[int, int, int, int, int, float, int, int]]:
    """(start, end, other start, other end, words, similarity, first word, last word) of the parts of two texts that align.

    Starts and ends are in characters of each, first and last words places in the first. Parts have at least MIN_WORDS words, of which at least
    SIMILARITY are in common; they don't overlap. `fixed`: words of common seeds.
    """
    sa, ea, wa = words_of(a)
    sb, eb, wb = words_of(b)
    if fixed:  # a source's piece may be wider than the chain needs
        q = [j for _, j in fixed]
        lo, hi = max(0, min(q) - MARGIN), max(q) + MIN_WORDS + MARGIN
        sb, eb, wb, fixed = sb[lo:hi], eb[lo:hi], wb[lo:hi], [(i, j - lo) for i, j in fixed]
    # Of a passage's words in a row, both texts have 2 * SIMILARITY - 1 of all at least: gaps part no more pairs.
    pairs, others = (w[:-1] * _P + w[1:] for w in (wa, wb))
    if sum(map(set(others.tolist()).__contains__, pairs.tolist())) < (2 * SIMILARITY - 1) * MIN_WORDS - 1:
        return []
    x, y = matches(wa, wb, fixed)
    out = []
    for lo, hi in stretches(x, y):
        words = int(max(x[hi] - x[lo], y[hi] - y[lo])) + 1
        out.append((int(sa[x[lo]]), int(ea[x[hi]]), int(sb[y[lo]]), int(eb[y[hi]]), words, (hi - lo + 1) / words, int(x[lo]), int(x[hi])))
    return out


def _copies(docs: DataFrame) -> DataFrame:
    """(doc_id, first, words, size) of the documents of which an earlier one has the same text."""
    text = F.col("text")
    later = group_of_equal(docs.select("doc_id", F.md5(text).alias("_md5")), "_md5", "doc_id", "first").where("doc_id <> first").drop("_md5")
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")
    return docs.join(later, "doc_id").select("doc_id", "first", words, F.length(text).cast("long").alias("size"))


class _Tied:
    """The rows of one task of tie(), which come in the order of key, document and word."""

    NAMES = ("key", "doc_id", "word", "f_doc", "f_word", "p_doc", "p_word", "before", "open")

    def __init__(self):
        self.key = None  # of the last row; with it its document and word, what is tied to, the key's places before its document and all so far, whether its key is the task's first
        self.doc = self.word = self.first = self.prior = None
        self.before, self.total, self.open = 0, 0, True

    def add(self, key: np.ndarray, doc: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
        n = len(key)
        fresh = self.key is None
        new_key = np.concatenate(([fresh or key[0] != self.key], key[1:] != key[:-1]))
        new_doc = new_key | np.concatenate(([fresh or doc[0] != self.doc], doc[1:] != doc[:-1]))
        row = np.arange(n)
        head = np.maximum.accumulate(np.where(new_key, row, -1))
        run = np.maximum.accumulate(np.where(new_doc, row, -1))
        f_doc, f_word = doc[head], word[head]
        before = run - head
        old = head < 0  # goes on from the batch before
        if old.any():
            f_doc, f_word = np.where(old, self.first[0], f_doc), np.where(old, self.first[1], f_word)
            before = np.where(old, np.where(run < 0, self.before, run + self.total), before)
        last = np.maximum(run - 1, 0)
        none = (run >= 0) & new_key[run]
        p_doc, p_word = doc[last], word[last]
        carried = run == 0
        if self.key is not None:
            p_doc, p_word = np.where(carried, self.doc, p_doc), np.where(carried, self.word, p_word)
            within = run < 0
            if within.any():
                p_doc, p_word, none = np.where(within, self.prior[0], p_doc), np.where(within, self.prior[1], p_word), np.where(within, self.prior[0] < -(1 << 62), none)
        p_doc = np.where(none, -(1 << 63), p_doc)
        opens = np.full(n, self.open and not fresh) if not new_key.any() else (row < (np.flatnonzero(new_key)[0] if not fresh else (np.flatnonzero(new_key)[1] if new_key.sum() > 1 else n))) & (self.open or fresh)
        self.key, self.doc, self.word, self.first, self.prior = key[-1], doc[-1], word[-1], (f_doc[-1], f_word[-1]), (p_doc[-1], p_word[-1])
        self.before, self.total, self.open = int(before[-1]), int(n - head[-1] if head[-1] >= 0 else self.total + n), bool(opens[-1])
        keep = opens | ~new_key
        return [x[keep] for x in (key, doc, word, f_doc, f_word, p_doc, p_word, before, opens.astype(np.int64))]

    def last(self) -> list[np.ndarray]:
        """What the next task goes on from, as a row."""
        row = (self.key, self.doc, self.word, *self.first, *self.prior, self.total, 2)
        return [np.array([x], np.int64) for x in row]


def tie(rows: DataFrame, name: str) -> DataFrame:
    """(key, doc_id, word, f_doc, f_word, p_doc, p_word, before) of the `rows` (key, doc_id, word) whose key an earlier document has."""
    return _tied_places(rows, name).where("doc_id <> f_doc")


def _tied_places(rows: DataFrame, name: str) -> DataFrame:
    """As tie(), and beside these the places of a key in its first document but the first, so that with f all places of a key that has several are there.

    f: the first place of the key. p: its last place in the document before this one, of those that have it. before: how many places of the key
    the documents before this one have (where a document's places go over several tasks, its own may count too).
    Rows are dealt in ranges of (key, doc_id, word), so a frequent key's are dealt to many tasks; what goes over from one task to the next is one row for each.
    """
    spark = rows.sparkSession
    names = _Tied.NAMES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tied, part = _Tied(), TaskContext.get().partitionId()

        def out(columns: list[np.ndarray]) -> pa.RecordBatch:
            key, doc, word, f_doc, f_word, p_doc, p_word, before, opens = columns
            arrays = [pa.array(key), pa.array(doc), pa.array(word, pa.int32()), pa.array(f_doc), pa.array(f_word, pa.int32()), pa.array(p_doc, mask=p_doc == -(1 << 63)), pa.array(p_word, pa.int32()), pa.array(before), pa.array(opens, pa.int32())]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(key), part), pa.int32())], [*names, "part"])

        for b in batches:
            if b.num_rows:
                yield out(tied.add(*[b.column(i).to_numpy().astype(np.int64) for i in range(3)]))
        if tied.key is not None:
            yield out(tied.last())

    ordered = rows.repartitionByRange("key", "doc_id", "word").sortWithinPartitions("key", "doc_id", "word")
    schema = "key long, doc_id long, word int, f_doc long, f_word int, p_doc long, p_word int, before long, open int, part int"
    found = write_table(map_in_arrow(ordered, run, schema, rows=1 << 16), name)
    carried, now = [], None
    for r in found.where("open = 2").orderBy("part").collect():  # one row for each task
        if now:
            carried.append((r.part, *now))
        own = (r.key, r.f_doc, r.f_word, r.doc_id, r.word, r.p_doc, r.p_word, r.before)
        if now and now[0] == r.key:
            prior = own[5:7] if r.p_doc is not None else now[3:5] if now[3] != r.doc_id else now[5:7]
            own = (r.key, *now[1:3], r.doc_id, r.word, *prior, now[7] + r.before)
        now = own
    carry = F.broadcast(spark.createDataFrame(carried, "part int, _key long, _f_doc long, _f_word int, _doc long, _word int, _p_doc long, _p_word int, _places long"))
    rows = found.where("open < 2").join(carry, ["part"], "left")
    goes_on = (F.col("open") == 1) & (F.col("_key") == F.col("key"))
    other = goes_on & F.col("p_doc").isNull()
    last, prior = F.col("_doc") != F.col("doc_id"), lambda a, b: F.when(other, F.when(last, F.col(a)).otherwise(F.col(b)))
    return rows.select(
        "key", "doc_id", "word", F.when(goes_on, F.col("_f_doc")).otherwise(F.col("f_doc")).alias("f_doc"), F.when(goes_on, F.col("_f_word")).otherwise(F.col("f_word")).alias("f_word"),
        F.when(other, prior("_doc", "_p_doc")).otherwise(F.col("p_doc")).alias("p_doc"), F.when(other, prior("_word", "_p_word")).otherwise(F.col("p_word")).alias("p_word"),
        (F.col("before") + F.when(goes_on, F.col("_places")).otherwise(F.lit(0))).alias("before"),
    )


def _lists(column: pa.ListArray) -> tuple[list[np.ndarray], np.ndarray]:
    """The fields of a column of lists of structs (nulls: -1), one after the other, and where each list ends (with a 0 before)."""
    flat, ends = column.flatten(), np.cumsum([0, *[len(x) for x in column]])
    return [flat.field(i).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(flat.type.num_fields)], ends


def _held(word: np.ndarray, span: np.ndarray) -> int:
    """How many words the seeds hold, at `word` (ascending) and so many long."""
    end = np.maximum.accumulate(word + span)
    return int(np.maximum(end - np.maximum(word, np.concatenate(([0], end[:-1]))), 0).sum())


def _chain(batches: Iterator[pa.RecordBatch], least: int = LEAST_WORDS) -> Iterator[pa.RecordBatch]:
    """(doc_id, list of word, span, f_doc, f_word, p_doc, p_word) -> chains: documents, words and seeds, which hold `least` words at least."""
    for b in batches:
        out = []
        fields, ends = _lists(b.column(1))
        for doc, lo, hi in zip(b.column(0).to_pylist(), ends[:-1], ends[1:]):
            word, span, f_doc, f_word, p_doc, p_word = (f[lo:hi] for f in fields)
            more = (p_word >= 0) & (p_doc != f_doc)
            word, span, source, other = np.concatenate((word, word[more])), np.concatenate((span, span[more])), np.concatenate((f_doc, p_doc[more])), np.concatenate((f_word, p_word[more]))
            order = np.lexsort((word, source))
            word, span, source, other = (x[order] for x in (word, span, source, other))
            starts = np.concatenate(([0], np.flatnonzero(np.diff(source)) + 1))
            enough = np.add.reduceat(span, starts) >= least  # most sources have one short seed only
            for first, last in zip(starts[enough].tolist(), np.append(starts[1:], len(word))[enough].tolist()):
                w, o, n = word[first:last], other[first:last], span[first:last]
                if _held(w, n) < least:
                    continue
                for members in chain_members(merge_diagonals(w, o, n)):
                    if sum(a[2] for a in members) < least:
                        continue
                    inside = np.zeros(len(w), bool)
                    for a, b_, size, _ in members:
                        i, j = np.searchsorted(w, (a, a + size))
                        inside[i:j] |= (w[i:j] - o[i:j] == a - b_) & (w[i:j] + n[i:j] <= a + size)
                    if _held(w[inside], n[inside]) < least:
                        continue
                    p, q = w[inside], o[inside]
                    s, e = max(0, int(p.min()) - MARGIN), int((p + n[inside]).max()) + MARGIN
                    os, oe = max(0, int(q.min()) - MARGIN) // GRID * GRID, -(-(int((q + n[inside]).max()) + MARGIN) // GRID) * GRID
                    out.append((doc, int(source[first]), s, e, os, oe, (p - s).tolist(), (q - os).tolist()))
        if out:
            kinds = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.list_(pa.int32())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "source_id", "s", "e", "os", "oe", "p", "q"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, list of lo, hi, salt in words) -> each piece, and the character that it starts at."""
    for b in batches:
        fields, ends = _lists(b.column(2))
        for doc, text, lo, hi in zip(b.column(0).to_pylist(), b.column(1), ends[:-1], ends[1:]):
            text = text.as_py()
            start, end, _ = words_of(text)
            if not len(start):
                continue
            a, z, salt = (f[lo:hi] for f in fields)
            at, to = start[np.minimum(a, len(start) - 1)], end[np.minimum(z, len(end)) - 1]
            pieces = [text[i:j] for i, j in zip(at.tolist(), to.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), doc)), pa.array(a, pa.int32()), pa.array(z, pa.int32()), pa.array(salt, pa.int32()), pa.array(at, pa.int64()), pa.array(pieces, pa.string())], ["doc_id", "lo", "hi", "salt", "at", "piece"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, source_id, first word of the piece, pieces and their first characters, seeds) -> passages."""
    for batch in batches:
        out = []
        for doc, source, s, a, b, at, other_at, p, q in zip(*[c.to_pylist() for c in batch.columns]):
            for start, end, other, other_end, words, similarity, first, last in align(a, b, list(zip(p, q))):
                out.append((doc, at + start, end - start, source, other_at + other, other_end - other, words, similarity, s + first, s + last))
        if out:
            kinds = [pa.int64()] * 7 + [pa.float64()] + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "start", "length", "source_id", "source_start", "source_length", "words", "similarity", "w0", "w1"])


def _aligned(tied: DataFrame, docs: DataFrame, name: str, least: int = LEAST_WORDS) -> DataFrame:
    """The passages of the chains of `tied` (doc_id, word, span, f_doc, f_word, p_doc, p_word), with their first and last word (w0, w1)."""
    by_doc = tied.groupBy("doc_id").agg(F.collect_list(F.struct("word", "span", "f_doc", "f_word", "p_doc", "p_word")).alias("hits"))  # bounded by the document's length
    schema = "doc_id long, source_id long, s int, e int, os int, oe int, p array<int>, q array<int>"
    chained = write_table(map_in_arrow(by_doc, lambda batches: _chain(batches, least), schema).withColumn("chain", F.monotonically_increasing_id()), f"{name}-chains")
    sides = [("doc_id", "s", "e", F.lit(0)), ("source_id", "os", "oe", F.pmod(F.xxhash64("chain"), F.lit(SALTS)).cast("int"))]
    wanted = [chained.select("chain", F.lit(i).alias("side"), F.col(d).alias("doc_id"), F.col(lo).alias("lo"), F.col(hi).alias("hi"), salt.alias("salt")) for i, (d, lo, hi, salt) in enumerate(sides)]
    wanted = wanted[0].union(wanted[1])
    # A frequent source gives a piece once for each salt, however many chains ask for it; then they are dealt by the salt too.
    asked = wanted.select("doc_id", "lo", "hi", "salt").distinct().groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "salt")).alias("asked"))
    pieces = map_in_arrow(_only(docs, wanted).hint("merge").join(asked, "doc_id").select("doc_id", "text", "asked"), _cut, "doc_id long, lo int, hi int, salt int, at long, piece string")
    given = wanted.hint("merge").join(pieces, ["doc_id", "lo", "hi", "salt"])
    of = lambda side, c: F.first(F.when(F.col("side") == side, F.col(c)), True)
    both = given.groupBy("chain").agg(of(0, "piece").alias("a"), of(1, "piece").alias("b"), of(0, "at").alias("a_at"), of(1, "at").alias("b_at")).hint("merge").join(chained, "chain")
    schema = "doc_id long, start long, length long, source_id long, source_start long, source_length long, words long, similarity double, w0 int, w1 int"
    found = write_table(map_in_arrow(both.select("doc_id", "source_id", "s", "a", "b", "a_at", "b_at", "p", "q"), _fit, schema), name)
    drop_table(chained)
    return found


def _left_over(tied: DataFrame, found: DataFrame) -> DataFrame:
    """(key, doc_id, word) of the long seeds that have more places before than they are tied to, where no passage covers all runs of MIN_WORDS about it."""
    long = tied.where(f"key & 1 = 1 and {UNTIED}").groupBy("doc_id").agg(F.collect_list(F.struct("key", "word")).alias("seeds"))
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("w0", "w1")).alias("spans"))
    both = long.join(spans, "doc_id", "left")
    covered = lambda s: F.exists("spans", lambda p: (p["w0"] <= F.greatest(s["word"] + LONG - MIN_WORDS, F.lit(0))) & (p["w1"] >= s["word"] + MIN_WORDS - 1))
    return both.select("doc_id", F.explode(F.filter("seeds", lambda s: ~F.coalesce(covered(s), F.lit(False)))).alias("s")).select("s.key", "doc_id", "s.word")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, places of long seeds) -> the hashes of all runs of MIN_WORDS words that hold one of them."""
    for b in batches:
        for doc, text, places in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            whole = grams(words_of(text.as_py())[2], MIN_WORDS)
            at = np.unique((np.array(places.as_py())[:, None] - np.arange(MIN_WORDS - LONG + 1)).ravel())
            at = at[(at >= 0) & (at < len(whole))]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(numbered(whole[at], at).view(np.int64)), pa.array(np.full(len(at), doc)), pa.array(at, pa.int32())], ["key", "doc_id", "word"])


def _holders(places: DataFrame, left: DataFrame, copies: DataFrame) -> DataFrame:
    """(key, doc_id, word) of all places of the seeds `left` over, but in later copies; some twice. Of `places` as of _tied_places()."""
    keys = left.select("key").distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = places.select("key", "doc_id", "word", "f_doc", "f_word").withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    own, first = F.struct("doc_id", "word"), F.struct(F.col("f_doc").alias("doc_id"), F.col("f_word").alias("word"))
    return salted.join(keys, ["key", "_salt"], "left_semi").select("key", F.explode(F.array(own, first)).alias("_at")).select("key", "_at.*").join(copies, "doc_id", "left_anti").select("key", "doc_id", "word")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The `docs` that may be among the `ids` (doc_id): told by BUCKETS numbers at most, so that texts that nobody asks for aren't shuffled."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))
    return docs.withColumn("_bucket", bucket).join(F.broadcast(ids.select(bucket.alias("_bucket")).distinct()), "_bucket", "left_semi").drop("_bucket")


def _exact_rest(docs: DataFrame, seeds: DataFrame, left: DataFrame, copies: DataFrame) -> DataFrame:
    """Ties of the runs of MIN_WORDS about the seeds `left` over, among all documents that have those seeds (`seeds`: as of _tied_places())."""
    holders = write_table(_holders(seeds.where("key & 1 = 1"), left, copies).groupBy("doc_id").agg(F.collect_set("word").alias("places")), "holders")
    runs = map_in_arrow(_only(docs, holders).hint("merge").join(holders, "doc_id").select("doc_id", "text", "places"), _runs, "key long, doc_id long, word int")
    return tie(write_table(runs, "runs"), "tied-runs")


def _outside(places: DataFrame, found: DataFrame) -> DataFrame:
    """The `places` (key, doc_id, word) of seeds that no passage of `found` holds."""
    own = places.groupBy("doc_id").agg(F.collect_list(F.struct("key", "word")).alias("seeds"))
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("w0", "w1")).alias("spans"))
    end = lambda s: s["word"] + F.when(s["key"].bitwiseAND(F.lit(1)) == 1, F.lit(LONG)).otherwise(F.lit(K)) - 1
    inside = lambda s: F.exists("spans", lambda p: (p["w0"] <= s["word"]) & (p["w1"] >= end(s)))
    left = F.filter("seeds", lambda s: ~F.coalesce(inside(s), F.lit(False)))
    return own.join(spans, "doc_id", "left").select("doc_id", F.explode(left).alias("s")).select("s.key", "doc_id", "s.word")


def _about(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, list of key, word, asked) -> of each place 16 bits of the hash of each word before the seed, the nearest first, and after it, REACH each, and how many words the text has."""
    for b in batches:
        fields, ends = _lists(b.column(2))
        for doc, text, lo, hi in zip(b.column(0).to_pylist(), b.column(1), ends[:-1], ends[1:]):
            code = (words_of(text.as_py())[2] >> np.uint64(48)).astype(np.uint16)
            key, word, asked = (f[lo:hi] for f in fields)
            near, padded = np.arange(REACH), np.pad(code, REACH)
            about = np.concatenate((padded[word[:, None] + REACH - 1 - near], padded[(word + np.where(key & 1, LONG, K))[:, None] + REACH + near]), axis=1)
            arrays = [pa.array(key), pa.array(asked, pa.int32()), pa.array(np.full(len(key), doc)), pa.array(word, pa.int32()), pa.array(np.full(len(key), len(code)), pa.int32()), pa.array([x.tobytes() for x in about], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "asked", "doc_id", "word", "words", "about"])


def _codes(side: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(n, REACH) bytes, and how many each has."""
    texts = side.to_pylist()
    size = np.array([len(x) for x in texts], np.int64)
    out = np.zeros((len(texts), REACH), np.uint8)
    out[np.arange(REACH) < size[:, None]] = np.frombuffer(b"".join(texts), np.uint8)
    return out, size


def _bits(code: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(n, 256): which bytes the first `size` of each have."""
    row, at = np.nonzero(np.arange(REACH) < size[:, None])
    bits = np.zeros((len(code), 256), bool)
    bits[row, code[row, at]] = True
    return bits


def _common_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(pairs, words + 1): how long a longest common subsequence of each row of b (64 at most) and the first 0, 1, 2, ... of the same row of a is; as in _common."""
    row = np.full(len(a), ~np.uint64(0))
    out = np.zeros((len(a), a.shape[1] + 1), np.uint8)
    for i in range(a.shape[1]):
        u = row & np.packbits(b == a[:, i, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        row = row + u | row - u
        out[:, i + 1] = 64 - np.bitwise_count(row)
    return out


def _may_align(a: list[np.ndarray], b: list[np.ndarray], span: int) -> np.ndarray:
    """Of pairs of places, of whose sides a and b are the bytes (-1, -2: the text has ended), whether of some MIN_WORDS words in a row that hold the seed all but LACK can be in common, in their order."""
    rest = MIN_WORDS - span
    left, right = (_common_lengths(x[:, :rest], y) for x, y in zip(a, b))
    return (left + right[:, ::-1]).max(axis=1, initial=0) >= rest - LACK


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, earlier and later places: lists of document, word, left, right) -> all pairs of places about which enough words are in common, as in _alike."""
    for b in slices(batches, 128, 1 << 20):
        (e_doc, e_word, e_sides, e_ends), (d_doc, d_word, d_sides, d_ends) = (_places(b.column(i)) for i in (1, 2))
        for cell, size in enumerate(np.where(b.column(0).to_numpy() & 1, LONG, K).tolist()):
            e, d = slice(e_ends[cell], e_ends[cell + 1]), slice(d_ends[cell], d_ends[cell + 1])
            for i, j in _alike(d_doc[d], [(c[d], n[d]) for c, n in d_sides], e_doc[e], [(c[e], n[e]) for c, n in e_sides], size):
                fits = _may_align(*_signed(d_sides, i + d.start, e_sides, j + e.start), size)
                i, j = i[fits] + d.start, j[fits] + e.start
                yield pa.RecordBatch.from_arrays([pa.array(d_doc[i]), pa.array(d_word[i], pa.int32()), pa.array(np.full(len(i), size), pa.int32()), pa.array(e_doc[j]), pa.array(e_word[j], pa.int32())], ["doc_id", "word", "span", "f_doc", "f_word"])


def _signed(d_sides: list, i: np.ndarray, e_sides: list, j: np.ndarray) -> list[list[np.ndarray]]:
    """The sides of the places i and j, 64 wide; -1 and -2 where a text has ended."""
    return [[np.where(np.arange(64) < length[k, None], np.pad(code[k].astype(np.int32), ((0, 0), (0, 64 - REACH))), end) for code, length in of] for of, k, end in ((d_sides, i, -1), (e_sides, j, -2))]


def _alike(d_doc: np.ndarray, d_sides: list, e_doc: np.ndarray, e_sides: list, span: int, whole: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a later and an earlier place of one seed (e_doc ascends) about which, by bytes of words, enough are in common, in any order.

    MIN_WORDS words that hold a seed hold three quarters of the rest of them in one of four ways about it, and lack no more than LACK of those about the other place. That is
    asked first, by products of which words either has; then of all the words. What is turned down has too few in common for certain. With `whole`, words in common
    must also reach over MIN_WORDS words, as a passage's do.
    """
    if not len(d_doc) or not len(e_doc):
        return
    has, rest = np.concatenate([_bits(*x) for x in e_sides], axis=1), MIN_WORDS - span
    others, ways = has.astype(np.float32), []
    for quarters in range(4):  # so many on the left
        width = rest * quarters // 4, rest * (3 - quarters) // 4
        wanted = np.concatenate([_bits(code, np.minimum(size, w)) for (code, size), w in zip(d_sides, width)], axis=1)
        ended = sum(np.maximum(w - size, 0) for (_, size), w in zip(d_sides, width))  # words that the text is too short for
        ways.append((wanted, wanted.sum(1) + ended - LACK, slice(0 if quarters else 256, 512 if quarters < 3 else 256)))
    for at in range(0, len(d_doc), 256):
        own = slice(at, min(at + 256, len(d_doc)))
        n = np.searchsorted(e_doc, d_doc[own].max())
        near = np.zeros((own.stop - at, n), bool)
        for wanted, least, used in ways:
            near |= wanted[own, used].astype(np.float32) @ others[:n, used].T >= least[own, None]
        d, e = np.nonzero(near)
        before = e_doc[e] < d_doc[own][d]
        yield from _in_common(d[before] + at, e[before], d_sides, has, rest, whole)


def _in_common(d: np.ndarray, e: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]], has: np.ndarray, rest: int, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs d, e that may have all but LACK of `rest` words in a row about a seed in common, in any order; 8192 at most at once."""
    width = REACH if whole else rest
    for part in range(0, len(d), 1 << 13):
        i, j = d[part : part + (1 << 13)], e[part : part + (1 << 13)]
        held, far = np.zeros((2, len(i), rest + 1), np.uint8), 0
        for side, (code, size) in enumerate(sides):
            common = has[j[:, None], code[i, :width].astype(np.int64) + 256 * side] & (np.arange(width) < size[i, None])
            np.cumsum(common[:, :rest], axis=1, out=held[side, :, 1:])
            far = far + np.where(common.any(1), width - common[:, ::-1].argmax(1), 0)
        fits = (held[0] + held[1][:, ::-1]).max(axis=1) >= rest - LACK
        if whole:
            fits &= far >= rest
        yield i[fits], j[fits]


def _places(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Documents, words and both sides' bytes of a column of lists of places, one list after the other and each by document, and where each ends (with a 0 before)."""
    flat, ends = column.flatten(), np.cumsum([0, *[len(x) for x in column]])
    doc, word = (flat.field(i).to_numpy() for i in (0, 1))
    order = np.lexsort((doc, np.repeat(np.arange(len(column)), np.diff(ends))))
    return doc[order], word[order], [tuple(x[order] for x in _codes(flat.field(i))) for i in (2, 3)], ends


def _reaches(left: np.ndarray, right: np.ndarray, span: int) -> np.ndarray:
    """The best sum of a gain on the left and one on the right, given for 0, 1, 2, ... words, that with the seed make MIN_WORDS words."""
    if not len(left):
        return np.zeros(0)
    best = np.maximum.accumulate(right[:, ::-1], axis=1)[:, ::-1]
    return (left + best[:, np.clip(MIN_WORDS - span - np.arange(left.shape[1]), 0, best.shape[1] - 1)]).max(axis=1)


def _wide(a: list[np.ndarray], b: list[np.ndarray], span: int) -> np.ndarray:
    """Of pairs of places, as in _may_align, whether in any order enough words are in common, and in both texts reach over MIN_WORDS words."""
    rest, reach, held = MIN_WORDS - span, [0, 0], []
    for x, y in zip(a, b):
        hit = x[:, :REACH, None] == y[:, None, :REACH]
        common = [hit.any(2), hit.any(1)]
        reach = [r + np.where(c.any(1), REACH - c[:, ::-1].argmax(1), 0) for r, c in zip(reach, common)]
        held.append(np.pad(np.cumsum(common[0][:, :rest], axis=1), ((0, 0), (1, 0))))
    return ((held[0] + held[1][:, ::-1]).max(axis=1) >= rest - LACK) & (reach[0] >= rest) & (reach[1] >= rest)


def _surplus(a: list[np.ndarray], b: list[np.ndarray], span: int) -> np.ndarray:
    """Of pairs of places, as in _may_align: how many words more than SIMILARITY asks for the best stretch of a has in common, MIN_WORDS long at least, from a word in common to another, about the seed."""
    gains = []
    for x, y in zip(a, b):
        row, size = np.full(len(x), ~np.uint64(0)), np.arange(REACH + 1)
        in_common = np.full((len(x), REACH + 1), -1e9)
        in_common[:, 0] = 0
        for i in range(REACH):
            mask = np.packbits(y == x[:, i, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
            below = mask.copy()
            for step in (1, 2, 4, 8, 16, 32):
                below |= below >> np.uint64(step)
            below >>= np.uint64(1)  # the places before the last that is this word
            in_common[:, i + 1] = np.where(mask != 0, np.bitwise_count(~row & below) + 1.0, -1e9)
            u = row & mask
            row = row + u | row - u
        gains.append(in_common - SIMILARITY * size)
    return _reaches(*gains, span) + (1 - SIMILARITY) * span + 1e-6


def _shared(cell: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]], span: np.ndarray) -> np.ndarray:
    """The places about which enough pairs of words are also about another place of the cell for a passage.

    Of m words in common a passage has m / 4 gaps at most, so m * 3 / 4 - 1 pairs of them follow each other in both texts; span + 1 of them touch the seed.
    Pairs are counted by a hash, so what is turned down has too few for certain.
    """
    hashes, there = [], []
    for side, (code, size) in enumerate(sides):
        pair = code[:, :-1].astype(np.uint64) << np.uint64(16) | code[:, 1:]
        hashes.append(_mix((pair << np.uint64(1) | np.uint64(side)) ^ cell.astype(np.uint64)[:, None] * _P))
        there.append(np.arange(1, REACH) < size[:, None])
    bits = max(16, int(4 * sum(map(np.sum, there))).bit_length())
    at = [(h >> np.uint64(64 - bits)).astype(np.int64) for h in hashes]
    count = np.bincount(np.concatenate([x[t] for x, t in zip(at, there)]), minlength=1 << bits)
    gains = []
    for x, t, (_, size) in zip(at, there, sides):
        gain = np.zeros((len(x), REACH + 1))
        gain[:, 2:] = np.cumsum((count[x] > 1) & t, axis=1)
        gain -= 0.75 * SIMILARITY * np.arange(REACH + 1)
        gain[np.arange(REACH + 1) > size[:, None]] = -1e9
        gains.append(gain)
    out = np.zeros(len(cell), bool)
    for s in (K, LONG):
        own = span == s
        out[own] = _reaches(*[g[own] for g in gains], s) >= 0.75 * SIMILARITY * s - s - 2 - 1e-6
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns key, row, column, later, doc_id, word, words, about of batches that are sorted by the first three, some 4096 rows at once, cells whole."""
    def read(b: pa.RecordBatch) -> list[np.ndarray]:
        return [*[b.column(i).to_numpy() for i in range(7)], np.frombuffer(b"".join(b.column(7).to_pylist()), np.uint16).reshape(-1, 2 * REACH)]

    held, rows = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(read(b))
        rows += b.num_rows
        if rows < 4096:
            continue
        whole = [np.concatenate(x) for x in zip(*held)]
        last = np.flatnonzero(np.any([x[:-1] != x[1:] for x in whole[:3]], axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield [x[:cut] for x in whole]
        held, rows = [[x[cut:] for x in whole]], len(whole[0]) - cut
    if rows:
        yield [np.concatenate(x) for x in zip(*held)]


def _candidates(batches: Iterator[pa.RecordBatch], best: bool) -> Iterator[pa.RecordBatch]:
    """Places as in _cells() -> the pairs of places that may lie in a passage; with `best`, of each later place the one that has most in common, of equal ones the first."""
    for key, row, column, later, doc, word, words, about in _cells(batches):
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (column[1:] != column[:-1])))
        cell, span = np.cumsum(new), np.where(key & 1, LONG, K)
        sides = [(about[:, :REACH], np.minimum(word, REACH)), (about[:, REACH:], np.clip(words - word - span, 0, REACH))]
        kept = np.lexsort((word, doc, cell))
        for _ in range(3):  # what goes takes its pairs of words along
            if len(kept):
                kept = kept[_shared(cell[kept], [(code[kept], size[kept]) for code, size in sides], span[kept])]
        ends = np.flatnonzero(np.concatenate(([True], np.diff(cell[kept]) != 0, [True]))) if len(kept) else np.zeros(1, int)
        pairs: dict[int, list] = {K: [], LONG: []}
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
            own = kept[lo:hi]
            d, e = own[later[own] > 0], own[later[own] < 2]  # 0: earlier, 1: both, 2: later
            if not len(d) or not len(e) or doc[e[0]] >= doc[d[-1]]:
                continue
            size = int(span[own[0]])
            for x, y in _alike(doc[d], [((c[d] >> 8).astype(np.uint8), n[d]) for c, n in sides], doc[e], [((c[e] >> 8).astype(np.uint8), n[e]) for c, n in sides], size, True):
                pairs[size].append((d[x], e[y]))
        for size, some in pairs.items():
            d, e = (np.concatenate(x) for x in zip(*some)) if some else (np.zeros(0, int),) * 2
            if not len(d):
                continue
            found = []
            for at in range(0, len(d), 2048):
                x, y = d[at : at + 2048], e[at : at + 2048]
                both = _signed(sides, x, sides, y)
                wide = np.flatnonzero(_wide(*both, size))
                more = _surplus(*[[side[wide] for side in of] for of in both], size)
                fits = more >= 0
                found.append((x[wide[fits]], y[wide[fits]], more[fits]))
            x, y, more = (np.concatenate(f) for f in zip(*found))
            if best and len(x):
                order = np.lexsort((word[y], doc[y], -more, x))
                order = order[np.concatenate(([True], np.diff(x[order]) != 0))]
                x, y, more = x[order], y[order], more[order]
            if len(x):
                arrays = [pa.array(key[x]), pa.array(doc[x]), pa.array(word[x], pa.int32()), pa.array(np.full(len(x), size), pa.int32()), pa.array(doc[y]), pa.array(word[y], pa.int32()), pa.array(more)]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "doc_id", "word", "span", "f_doc", "f_word", "more"])


def _places_about(docs: DataFrame, seeds: DataFrame, places: DataFrame, copies: DataFrame) -> DataFrame:
    """(key, asked, doc_id, word, words, about) of all places of the seeds at `places` (key, doc_id, word), those `places` asked; later copies have none that aren't."""
    both = _holders(seeds, places, copies).withColumn("asked", F.lit(0)).union(places.select("key", "doc_id", "word", F.lit(1))).groupBy("key", "doc_id", "word").agg(F.max("asked").alias("asked"))
    asked = write_table(both.groupBy("doc_id").agg(F.collect_list(F.struct("key", "word", "asked")).alias("places")), "asked")  # bounded by the document's length
    schema = "key long, asked int, doc_id long, word int, words int, about binary"
    return write_table(map_in_arrow(_only(docs, asked).hint("merge").join(asked, "doc_id").select("doc_id", "text", "places"), _about, schema), "about")


def _untied(about: DataFrame, best: bool) -> DataFrame:
    """Ties (key, doc_id, word, span, f_doc, f_word) of the places `about` that are asked to those of the same seed in earlier documents that may lie in a passage with them: all, or the best.

    All pairs of a seed's places are looked at that share enough pairs of words with any: at worst that grows with the square of a common line's documents. A seed's
    places are dealt to squares of at most about BLOCK by BLOCK, so no task holds more.
    """
    large = about.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n")).where("n > 1")  # a row for each BLOCK places at most
    dealt = about.join(F.broadcast(large), "key", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("_own", F.pmod(F.xxhash64("doc_id", "word"), F.col("n")).cast("int"))
    one = F.array(F.struct(F.lit(0).alias("_row"), F.lit(0).alias("_column"), F.col("asked").alias("later")))
    others = F.sequence(F.lit(0), F.col("n") - 1)
    earlier = F.transform(others, lambda i: F.struct(F.col("_own").alias("_row"), i.alias("_column"), F.lit(0).alias("later")))
    later = F.transform(others, lambda i: F.struct(i.alias("_row"), F.col("_own").alias("_column"), F.lit(2).alias("later")))
    squares = F.when(F.col("n") == 1, one).when(F.col("asked") == 1, F.concat(earlier, later)).otherwise(earlier)
    rows = dealt.withColumn("_at", F.explode(squares)).select("key", "_at._row", "_at._column", "_at.later", "doc_id", "word", "words", "about")
    cells = ["key", "_row", "_column"]
    sorted_rows = rows.repartition(int(about.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cells).sortWithinPartitions(*cells)
    schema = "key long, doc_id long, word int, span int, f_doc long, f_word int, more double"
    found = map_in_arrow(sorted_rows, lambda batches: _candidates(batches, best), schema, rows=4096)
    if best:  # of all squares
        found = found.groupBy("key", "doc_id", "word", "span").agg(F.max_by(F.struct("f_doc", "f_word"), F.struct("more", -F.col("f_doc"), -F.col("f_word"))).alias("f")).select("key", "doc_id", "word", "span", "f.f_doc", "f.f_word")
    return write_table(found.select("key", "doc_id", "word", "span", "f_doc", "f_word"), "untied")


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        part = np.cumsum([len(t) for t in texts]) >> 18  # about so many characters at once
        for at in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(part)) + 1):
            code, text, word = seeds_of_all([texts[i] for i in at])
            if len(code):
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(b.column(0).to_numpy()[at][text]), pa.array(word)], ["key", "doc_id", "word"])


def find_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, source_id, source_start, source_length, words, similarity, text_id): passages that an earlier document has.

    Of `docs` (doc_id, text; other columns are left alone). Copies of a whole text are given as one passage of it, without a
    comparison. Null, empty and short texts have no passages, nor have rows without an id. Rows of one id and different texts are documents of their own, in the order of `text_id`, a hash of
    the text that tells them apart; rows that are the same in both count as one. Starts are 0-based characters. No rows: none.
    """
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("text_id")).where("doc_id is not null and text is not null")
    names = write_table(own.select("doc_id", "text_id").distinct(), "names")
    if names.groupBy("doc_id").count().where("count > 1").isEmpty():
        return _passages(own.select("doc_id", "text")).join(names, "doc_id")
    # numbers in the order of ids and texts stand for documents
    numbers = write_table(running_totals(names, ["doc_id", "text_id"], {"number": F.lit(1).cast("long")}), "numbers")
    found = _passages(own.join(numbers, ["doc_id", "text_id"]).select(F.col("number").alias("doc_id"), "text"))
    found = found.withColumnsRenamed({"doc_id": "_own", "source_id": "_other"})
    named = found.join(numbers.select(F.col("number").alias("_own"), "doc_id", "text_id"), "_own").join(numbers.select(F.col("number").alias("_other"), F.col("doc_id").alias("source_id")), "_other")
    return named.select("doc_id", "start", "length", "source_id", "source_start", "source_length", "words", "similarity", "text_id")


def _passages(docs: DataFrame) -> DataFrame:
    """The passages of documents that have an id of their own each."""
    copies = write_table(_copies(docs), "copies")
    later = copies.select("doc_id").distinct()
    seeds = write_table(map_in_arrow(docs, _seeds, "key long, doc_id long, word int"), "seeds")
    ties = _tied_places(seeds, "tied")
    drop_table(seeds)
    tied = ties.where("doc_id <> f_doc").join(later, "doc_id", "left_anti")
    span = F.when(F.col("key").bitwiseAND(F.lit(1)) == 1, F.lit(LONG)).otherwise(F.lit(K))
    found = _aligned(tied.withColumn("span", span), docs, "passages")
    left = write_table(_left_over(tied, found), "left-over")
    places = write_table(_outside(tied.where(UNTIED), found), "places")
    rest = _exact_rest(docs, ties, left, later)
    none = F.lit(None)
    more = _aligned(rest.withColumns({"span": F.lit(MIN_WORDS), "p_doc": none.cast("long"), "p_word": none.cast("int")}), docs, "more-passages")
    about = _places_about(docs, ties, write_table(_outside(places, more), "places"), later)
    for used in (ties, left, rest):
        drop_table(used)
    alone = {"p_doc": none.cast("long"), "p_word": none.cast("int")}
    first = _untied(about, True)
    best = _aligned(first.drop("key").withColumns(alone), docs, "best-passages", K)
    # Where a place's best match is in no passage, all others are tried.
    open_places = _outside(first.select("key", "doc_id", "word"), best).withColumn("again", F.lit(1))
    again = about.join(open_places.select("key").distinct(), "key", "left_semi").join(open_places, ["key", "doc_id", "word"], "left").withColumn("asked", F.coalesce("again", F.lit(0))).drop("again")
    second = _untied(again.select(*about.columns), False)
    last = _aligned(second.drop("key").withColumns(alone), docs, "last-passages", K)
    zero = F.lit(0).cast("long")
    return found.union(more).union(best).union(last).drop("w0", "w1").distinct().union(copies.where(F.col("words") >= MIN_WORDS).select("doc_id", zero, "size", "first", zero, "size", "words", F.lit(1.0)))


def remove_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """`docs` with the passages cut out of their texts; n_chars, where there is such a column, follows. All rows and columns stay, whatever they are called."""
    spans = passages.groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    row = F.col("row.text")
    step = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["kept"], F.when(s["start"] > acc["at"], F.substring(row, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))).otherwise(F.lit(""))).alias("kept"),
            F.greatest(acc["at"], s["start"] + s["length"]).alias("at"),
        ),
        lambda acc: F.concat(acc["kept"], F.substring(row, (acc["at"] + 1).cast("int"), F.greatest(F.lit(0), F.length(row) - acc["at"]).cast("int"))),
    )
    # Texts are joined one way at any size: how many passages there are isn't bounded.
    joined = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_id"), F.struct("*").alias("row")).hint("merge").join(spans, ["doc_id", "text_id"], "left")
    cut = joined.select("row", F.when(F.col("spans").isNotNull(), step).otherwise(row).alias("text"), F.col("spans").isNotNull().alias("cut"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("cut"), F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return cut.select(*[(new[c] if c in new and c in docs.columns else F.col("row")[c]).alias(c) for c in docs.columns])
