"""Line dedup by an exact set-similarity join.

A line is the set of its words (see ``vec``); lines end at newlines. A line is removed when an earlier
line has a word set of Jaccard similarity at least ``threshold``, removed itself or not. Earlier means a
smaller doc_id (null ids last, ties by the hash of the row), then a smaller line number.

Equal sets are found by a hash aggregation. The rest is a prefix-filter join over the distinct sets. Words
are ordered by rarity, counted over all documents in a fixed table of hash buckets (any fixed order is
exact, rarity only makes it fast). Two sets that match share a word among the ``n - ceil(t n) + 1`` rarest
of each, and two among one more. So the first shared word is the join key where it is rare; where it is
frequent all shared words are, and the first two together are the key, which keeps posting lists short as
the corpus grows. Postings are filtered by length, by position and by the parity bits of the words, which
bound the difference of two sets from below. What remains is verified on the whole sets.

Keys that very many sets share, as a sample of the documents tells, are split: a set is first compared with
its part of the key only, and where that doesn't settle it, it is sent to all parts. So no task holds a key
of any size, and the sample decides on the way, not on the result.

Defined cases: a line without words is never removed and matches nothing; null and empty texts have no
lines and stay. Of wholly repeated rows one stays. ``keep_lines`` drops a document only if it had words
and none is left; n_chars, if there, is brought up to date. An empty table gives an empty table. Further
columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vec
from .common import cut, narrow, positional, row_key

THRESHOLD = Fraction(4, 5)
#: words of more lines than RARE count as frequent: a list of so many postings is compared about as cheaply as
#: the word pairs that take its place are sent
BUCKETS, RARE = 22, 2048
#: candidates of a set in one key that are verified first: where the closest lies well within the bound, and elsewhere
BEST = (2, 12)
#: sets of more words have a second word of parity bits in their postings
WIDE = 64
#: postings of a key beyond which it is split, and the share of documents that is looked at for such keys
HOT, SAMPLE = 1 << 18, 64
_PAIRS, _HELD = 1 << 19, 1 << 22
_SPLIT = 1 << 31
Hot = tuple[tuple[np.ndarray, int], int]
_LAST = (1 << 63) - 1
_PARITY = ("p0", "p1", "p2", "p3")


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS)).astype(np.int64)


def line_words(column: pa.Array, code: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Per chunk of rows: the row and number of each line with words, its set's bounds, and the words.

    With ``code`` (the rarity of each bucket) a line's words are distinct and rarest first.
    """
    data, offsets = vec.flat(column)
    for i, j in vec.chunks(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        ends = np.flatnonzero(part == 10) + 1
        bounds = np.unique(np.concatenate([at, ends]))
        h, _, wb = vec.words(part, bounds)
        if not len(h):
            continue
        sizes = np.diff(wb)
        begin = bounds[:-1]
        row = np.searchsorted(at, begin, "right") - 1
        number = np.searchsorted(ends, begin, "right") - np.searchsorted(ends, at[row], "right")
        if code is not None:
            line = np.repeat(np.arange(len(sizes)), sizes)
            h, line = _distinct(h, line, code)
            sizes = np.bincount(line, minlength=len(sizes))
        full = sizes > 0
        yield row[full] + i, number[full], np.r_[0, np.cumsum(sizes[full])], h


def _distinct(h: np.ndarray, line: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rarity = code[_bucket(h)].astype(np.uint64)
    key = (line.astype(np.uint64) << np.uint64(44)) | (rarity << np.uint64(36)) | (h & np.uint64((1 << 36) - 1))
    o = np.argsort(key)
    same = key[o][1:] == key[o][:-1]
    if line[-1] >= 1 << 20 or (h[o][1:] != h[o][:-1])[same].any():
        o = np.lexsort((h, h & np.uint64((1 << 36) - 1), rarity, line))
        same = (line[o][1:] == line[o][:-1]) & (h[o][1:] == h[o][:-1])
    o = o[np.r_[True, ~same]]
    return h[o], line[o]


def set_ids(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(vec.mix(h ^ np.uint64(0x5851F42D4C957F2D)), bounds[:-1]).view(np.int64)


def survey(docs: DataFrame) -> DataFrame:
    """One scan for two results: doc_id, key, line_no (from 1) and set id of every line with words, and
    in other rows a bucket b of words with the number n of lines that hold one, summed over some batches."""
    rows = narrow(docs, "doc_id", "text").select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    none = np.zeros(1 << BUCKETS, np.uint8)
    names = ["doc_id", "key", "line_no", "sid", "b", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, id_type = 0, None

        def counts() -> pa.RecordBatch:
            b, n = np.unique(np.concatenate(held), return_counts=True)
            void = [pa.nulls(len(b), t) for t in (id_type, pa.int64(), pa.int64(), pa.int64())]
            return pa.RecordBatch.from_arrays([*void, pa.array(b), pa.array(n)], names=names)

        for batch in batches:
            id_type = batch.column(0).type
            for row, number, bounds, h in line_words(batch.column(2), none):
                at, void = pa.array(row), [pa.nulls(len(row), pa.int32()), pa.nulls(len(row), pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(number + 1), pa.array(set_ids(h, bounds)), *void], names=names)
                held.append(_bucket(h).astype(np.int32))
                size += len(h)
            if size > 1 << 21:
                yield counts()
                held, size = [], 0
        if size:
            yield counts()

    return rows.mapInArrow(run, f"doc_id {kind}, key long, line_no long, sid long, b int, n long")


def rarity(surveyed: DataFrame) -> tuple[np.ndarray, int]:
    """The logarithmic line count of each bucket, 0 where a bucket's word stands in one line; the code
    above which words are frequent. The table has a fixed size, whatever the corpus."""
    counts = surveyed.where("b is not null").groupBy("b").agg(F.sum("n").alias("n")).where("n > 1")
    got = counts.select("b", F.least(F.lit(255), F.floor(8 * F.log2("n"))).cast("short").alias("code")).toArrow()
    code = np.zeros(1 << BUCKETS, np.uint8)
    code[got.column("b").to_numpy()] = got.column("code").to_numpy()
    usual = int(np.median(code[code > 0])) if (code > 0).any() else 0
    return code, max(int(8 * np.log2(RARE)), usual + 16)


def _keys(h: np.ndarray, bounds: np.ndarray, code: np.ndarray, frequent: int, t: Fraction) -> tuple[np.ndarray, ...]:
    """Join keys: the line of each, the key and the position of its first word."""
    n = np.diff(bounds)
    p = n - -(-n * t.numerator // t.denominator) + 1
    far = np.minimum(p + 1, n)
    line = np.repeat(np.arange(len(n)), far)
    pos = np.arange(len(line)) - np.repeat(np.cumsum(far) - far, far)
    word = h[bounds[:-1][line] + pos]
    c = code[_bucket(word)]
    rare = (c <= frequent) & (c > 0) & (pos < p[line])  # a bucket's only word cannot be shared
    often = np.flatnonzero(c > frequent)
    ol, ow, op = line[often], word[often], pos[often]
    left = np.searchsorted(ol, ol, "right") - np.arange(len(ol)) - 1
    left[op >= p[ol]] = 0
    a = np.repeat(np.arange(len(ol)), left)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(left) - left, left)
    # a frequent word alone is the whole overlap of sets of one word, and those are found as equal sets
    return np.r_[line[rare], ol[a]], np.r_[word[rare], vec.mix(ow[a] * np.uint64(3) ^ vec.mix(ow[b]))], np.r_[pos[rare], op[a]]


def _parts(key: np.ndarray, part: np.ndarray | int) -> np.ndarray:
    return vec.mix(key + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(part, np.uint64) + np.uint64(1)))


def _split(line: np.ndarray, key: np.ndarray, pos: np.ndarray, sid: np.ndarray, hot: Hot, only: tuple[np.ndarray, int] | None, of: tuple[np.ndarray, int] | None) -> tuple[np.ndarray, ...]:
    """Lines, keys and marked positions with each hot key replaced by its part; what passes ``of`` goes to all
    parts. With ``only`` keys stay of which some part passes."""
    table, parts = hot
    split = _passes(table, key.view(np.int64))
    own = (sid[line] % parts).astype(np.int64)
    every = split & _passes(of, sid[line]) if of is not None else np.zeros(len(key), bool)
    some = np.ones(len(key), bool)
    if only is not None:
        some = np.where(split, False, _passes(only, key.view(np.int64)))
        at = np.flatnonzero(split)
        for k in range(parts):
            some[at] |= _passes(only, _parts(key[at], k).view(np.int64))
    plain, mine = np.flatnonzero(some & ~split), np.flatnonzero(some & split & ~every)
    wide = np.repeat(np.flatnonzero(some & every), parts)
    each = np.tile(np.arange(parts), len(wide) // parts)
    at = np.r_[plain, mine, wide]
    new = np.r_[key[plain], _parts(key[mine], own[mine]), _parts(key[wide], each)]
    return line[at], new, np.r_[pos[plain], pos[mine] | _SPLIT, pos[wide] | _SPLIT]


def postings(docs: DataFrame, code: np.ndarray, frequent: int, t: Fraction, only: tuple[np.ndarray, int] | None = None, of: tuple[np.ndarray, int] | None = None, hot: Hot | None = None) -> DataFrame:
    """key, sid, doc, line, spot (size, position and whether the key is split), parity, and for large sets the
    parity of half the words (``more``, or else 0), which makes 128 bits of the 64; with ``only``, of the keys
    that pass it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pc.fill_null(batch.column(0), _LAST).to_numpy(zero_copy_only=False)
            for row, number, bounds, h in line_words(batch.column(1), code):
                sid = set_ids(h, bounds)
                new = np.ones(len(sid), bool)
                o = np.lexsort((number, ids[row], sid))
                new[o[1:][sid[o][1:] == sid[o][:-1]]] = False  # the first of equal sets stands for them
                bit = np.uint64(1) << (h & np.uint64(63))
                parity = np.bitwise_xor.reduceat(bit, bounds[:-1])
                more = np.bitwise_xor.reduceat(np.where(h & np.uint64(64), bit, np.uint64(0)), bounds[:-1])
                more[np.diff(bounds) <= WIDE] = 0
                line, key, pos = _keys(h, bounds, code, frequent, t)
                keep = new[line]
                if only is not None and hot is None:
                    keep &= _passes(only, key.view(np.int64))
                line, key, pos = line[keep], key[keep], pos[keep]
                if hot is not None:
                    line, key, pos = _split(line, key, pos, sid, hot, only, of)
                spot = (np.diff(bounds)[line] << 32) | pos
                cols = [key.view(np.int64), sid[line], ids[row[line]], number[line], spot, parity[line].view(np.int64), more[line].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "sid", "doc", "line", "spot", "parity", "more"])

    rows = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "key long, sid long, doc long, line long, spot long, parity long, more long")


def hot_keys(docs: DataFrame, code: np.ndarray, frequent: int, t: Fraction) -> Hot | None:
    """A filter of the keys that look too large for one task, and the number of parts for the largest."""
    rows = narrow(docs, "doc_id", "text").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0)
    counts = cut(postings(rows, code, frequent, t).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLE * 2 > HOT), "hot")
    n, most = counts.agg(F.count("*"), F.max("n")).first()
    return (_filter(counts.select("key"), n), -(-most * SAMPLE * 2 // HOT)) if n else None


def _candidates(cols: list[np.ndarray], t: Fraction, best: tuple[int, int] | None, of: tuple[np.ndarray, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(later, earlier, key) for sets that share a key and pass the filters.

    With ``best`` a set that has more earlier partners in one key keeps those of the least parity distance,
    and a row without partner names the key that was cut short, or is a part of one. Without, every partner is given, of the later
    sets that pass ``of``.
    """
    key, sid, doc, line, spot, parity, more = cols
    o = np.lexsort((line, doc, sid, spot >> 32, key))
    o = o[np.r_[True, (key[o][1:] != key[o][:-1]) | (sid[o][1:] != sid[o][:-1])]]
    key, sid, doc, line, spot, parity, more = (c[o] for c in (key, sid, doc, line, spot, parity, more))
    # bits of signed numbers are counted without the sign
    size, pos, parity, more = spot >> 32, spot & (_SPLIT - 1), parity.view(np.uint64), more.view(np.uint64)
    less = parity ^ more
    n = len(key)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((sid, line, doc))] = np.arange(n)
    head = np.r_[True, key[1:] != key[:-1]]
    group = np.cumsum(head)
    # lengths rise within a key, so the partners of a set end where n t exceeds its own length
    wide = int(size.max()) * t.denominator + 2
    most = np.minimum(size * t.denominator // t.numerator, wide - 1)
    end = np.searchsorted(group * wide + size, group * wide + most, "right")
    count = end - np.arange(n) - 1
    total = np.cumsum(count)
    small = size.astype(np.int32)
    rest = ((size - pos) * (t.numerator + t.denominator)).astype(np.int32)
    asked = None if of is None else _passes(of, sid)
    split = np.flatnonzero(spot & _SPLIT) if best is not None else []
    if len(split):  # the other parts of the key are still to be seen
        yield sid[split], np.zeros(0, np.int64), key[split]
    pairs, held, i0 = [], 0, 0
    ends = np.append(np.flatnonzero(head)[1:], n)
    while i0 < n:
        # whole keys at a time, as many as the pair budget takes, one at least
        want = (total[i0 - 1] if i0 else 0) + _PAIRS
        k = int(np.searchsorted(ends, max(i0 + 1, int(np.searchsorted(total, want, "right"))), "left"))
        i1 = int(ends[min(k, len(ends) - 1)])
        for lo, hi in _steps(total, i0, i1):
            n_each = count[lo:hi]
            j = np.arange(int(n_each.sum()), dtype=np.int32)
            j += np.repeat((np.arange(lo, hi) + 1 - (np.cumsum(n_each) - n_each)).astype(np.int32), n_each)
            both = np.repeat(small[lo:hi], n_each) + small[j]
            # the shared words that are still possible are at least the overlap that the threshold asks for
            ok = np.flatnonzero((np.repeat(rest[lo:hi], n_each) >= t.numerator * both) & (rest[j] >= t.numerator * both))
            i, j, both = np.repeat(np.arange(lo, hi, dtype=np.int32), n_each)[ok], j[ok], both[ok]
            far = np.bitwise_count(parity[i] ^ parity[j]).astype(np.int32)
            ok = far * (t.numerator + t.denominator) <= (t.denominator - t.numerator) * both
            i, j, far, both = i[ok], j[ok], far[ok], both[ok]
            # sets of a key rise in size, so the first is the smaller
            large = np.flatnonzero(small[i] > WIDE)
            a, b = i[large], j[large]
            far[large] = np.bitwise_count(more[a] ^ more[b]).astype(np.int32) + np.bitwise_count(less[a] ^ less[b])
            ok = np.ones(len(far), bool)
            ok[large] = far[large] * (t.numerator + t.denominator) <= (t.denominator - t.numerator) * both[large]
            i, j, far = i[ok], j[ok], far[ok]
            swap = rank[i] > rank[j]
            i, j = np.where(swap, i, j), np.where(swap, j, i)
            if asked is not None:
                ok = asked[i]
                i, j, far = i[ok], j[ok], far[ok]
            if best is None:
                if len(i):
                    yield sid[i], sid[j], np.zeros(len(i), np.int64)
                continue
            pairs.append(np.stack([i, j, far]))
            held += len(i)
            if held > _HELD:  # one more than is kept tells that there were more
                pairs = [_closest(np.concatenate(pairs, axis=1), rank, best[1] + 1)[0]]
                held = pairs[0].shape[1]
        if held:
            (later, earlier, far), nth, head_at = _closest(np.concatenate(pairs, axis=1), rank, best[1] + 1)
            sure = 2 * far * (t.numerator + t.denominator) <= (t.denominator - t.numerator) * (small[later] + small[earlier])
            most_of = np.where(sure[head_at], *best)
            keep = nth < most_of
            yield sid[later[keep]], sid[earlier[keep]], np.zeros(int(keep.sum()), np.int64)
            cut_short = later[nth == most_of]
            if len(cut_short):
                yield sid[cut_short], np.zeros(0, np.int64), key[cut_short]
        pairs, held = [], 0
        i0 = i1


def _closest(pairs: np.ndarray, rank: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs by later set, then distance, then the earlier set's rank, at most so many of a set; the place
    of each among its set's pairs, and where those begin."""
    later, earlier, far = pairs
    o = np.lexsort((rank[earlier], far, later)) if len(rank) >= 1 << 28 else np.argsort((later.astype(np.int64) * 129 + far) * len(rank) + rank[earlier])
    pairs = pairs[:, o]
    at = np.arange(len(o))
    begin = np.maximum.accumulate(np.where(np.r_[True, pairs[0, 1:] != pairs[0, :-1]], at, 0))
    keep = np.flatnonzero(at - begin < most)
    start = np.cumsum(np.r_[False, begin[keep][1:] != begin[keep][:-1]])
    first = np.flatnonzero(np.r_[True, start[1:] != start[:-1]])
    return pairs[:, keep], (at - begin)[keep], first[start]


def _steps(total: np.ndarray, i0: int, i1: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``_PAIRS`` pairs."""
    while i0 < i1:
        j = min(i1, max(i0 + 1, int(np.searchsorted(total, (total[i0 - 1] if i0 else 0) + _PAIRS, "right"))))
        yield i0, j
        i0 = j


def candidates(docs: DataFrame, code: np.ndarray, frequent: int, t: Fraction, best: tuple[int, int] | None, only: tuple[np.ndarray, int] | None = None, of: tuple[np.ndarray, int] | None = None, hot: Hot | None = None) -> DataFrame:
    """later, earlier, key as ``_candidates`` has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if held:
            table = pa.Table.from_batches(held)
            del held
            for later, earlier, key in _candidates([c.to_numpy() for c in table.columns], t, best, of):
                other = pa.array(earlier) if len(earlier) else pa.nulls(len(later), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(later), other, pa.array(key)], names=["later", "earlier", "key"])

    return postings(docs, code, frequent, t, only, of, hot).repartition("key").mapInArrow(run, "later long, earlier long, key long")


def _passes(table: tuple[np.ndarray, int], ids: np.ndarray) -> np.ndarray:
    words, bits = table
    spot = (vec.mix(ids.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    return (words[spot >> 6] >> (spot & 63)) & 1 == 1


def _filter(ids: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """A Bloom filter of the one column, at most 32 MB; a full one only lets more through."""
    bits = int(np.clip(np.ceil(np.log2(max(count, 1) * 32)), 16, 28))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spot = np.unique((vec.mix(b.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64))
            if len(spot):
                word, first = np.unique(spot >> 6, return_index=True)
                mask = np.bitwise_or.reduceat(np.int64(1) << (spot & 63), first)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask)], names=["w", "m"])

    got = ids.mapInArrow(run, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got.column("w").to_numpy()] = got.column("m").to_numpy()
    return out, bits


def word_sets(docs: DataFrame, code: np.ndarray, wanted: tuple[np.ndarray, int]) -> DataFrame:
    """sid, words and 256 parity bits p0..p3: the sets that pass the filter, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, bounds, h in line_words(batch.column(0), code):
                sid = set_ids(h, bounds)
                one = np.zeros(len(sid), bool)
                one[np.unique(sid, return_index=True)[1]] = True
                pick = np.flatnonzero(_passes(wanted, sid) & one)
                sizes = np.diff(bounds)[pick]
                start = np.cumsum(sizes) - sizes
                at = np.repeat(bounds[:-1][pick] - start, sizes) + np.arange(sizes.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.r_[start, sizes.sum()].astype(np.int32)), pa.array(h[at].view(np.int64)))
                spot = h[at] & np.uint64(255)
                masks = []
                for w in range(4 if len(pick) else 0):
                    bit = np.where(spot >> np.uint64(6) == w, np.uint64(1) << (spot & np.uint64(63)), np.uint64(0))
                    masks.append(pa.array(np.bitwise_xor.reduceat(bit, start).view(np.int64)))
                if masks:
                    yield pa.RecordBatch.from_arrays([pa.array(sid[pick]), lists, *masks], names=["sid", "words", *_PARITY])

    return narrow(docs, "text").mapInArrow(run, "sid long, words array<long>, p0 long, p1 long, p2 long, p3 long").dropDuplicates(["sid"])


def _verified(docs: DataFrame, pairs: DataFrame, code: np.ndarray, t: Fraction) -> DataFrame:
    """The later sets of the pairs (later, earlier) whose whole word sets are similar enough."""
    ids = pairs.select(F.explode(F.array("later", "earlier")).alias("sid"))
    sets = cut(word_sets(docs, code, _filter(ids, 2 * pairs.count())), "sets")
    # most pairs that don't match fall by their parity bits, so the words travel for few
    size = F.size("words").alias("size")
    a = sets.select(F.col("sid").alias("later"), size.alias("na"), *[F.col(c).alias(f"a{c}") for c in _PARITY])
    b = sets.select(F.col("sid").alias("earlier"), size.alias("nb"), *[F.col(c).alias(f"b{c}") for c in _PARITY])
    apart = sum((F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in _PARITY), F.lit(0))
    within = F.col("apart") * (t.numerator + t.denominator) <= (F.col("na") + F.col("nb")) * (t.denominator - t.numerator)
    near = pairs.join(a, "later").join(b, "earlier").withColumn("apart", apart).where(within).select("later", "earlier", "apart")
    near = cut(near, "near")
    left, right = sets.select("sid", "words").toDF("later", "wa"), sets.select("sid", "words").toDF("earlier", "wb")
    both = F.size(F.array_intersect("wa", "wb")) * (t.numerator + t.denominator)

    def alike(some: DataFrame) -> DataFrame:
        full = some.join(left, "later").join(right, "earlier")
        return full.where(both >= (F.size("wa") + F.size("wb")) * t.numerator).select("later")

    # one match is enough: the pair of the fewest differing bits settles nearly every set
    closest = near.groupBy("later").agg(F.min(F.struct("apart", "earlier")).alias("pair"))
    done = cut(alike(closest.select("later", "pair.earlier")), "closest")
    others = cut(near.join(closest, "later").where("earlier <> pair.earlier").select("later", "earlier").join(done, "later", "left_anti"), "others")
    return done if others.isEmpty() else done.union(alike(others).distinct())


def similar_sets(docs: DataFrame, code: np.ndarray, frequent: int, t: Fraction) -> DataFrame:
    """sid: the distinct sets that are similar to one that occurs earlier and differs.

    One match is enough, so first the few closest candidates of a set in each key are verified, which
    settles the members of large groups. A set that isn't settled and had more candidates is then compared
    with all of them.
    """
    hot = hot_keys(docs, code, frequent, t)
    found = cut(candidates(docs, code, frequent, t, BEST, hot=hot), "candidates")
    pairs = cut(found.where("earlier is not null").select("later", "earlier").distinct(), "pairs")
    done = cut(_verified(docs, pairs, code, t), "similar")
    more = cut(found.where("earlier is null").select("later", "key").join(done, "later", "left_anti"), "open")
    count = more.count()
    if not count:
        return done.toDF("sid")
    asked = more.select("later").distinct()
    rest = candidates(docs, code, frequent, t, None, _filter(more.select("key"), count), _filter(asked, count), hot).select("later", "earlier")
    rest = cut(rest.join(asked, "later", "left_semi").distinct(), "rest")
    return done.union(_verified(docs, rest, code, t)).distinct().toDF("sid")


def removals(docs: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """doc_id, key, line_no, times, n: the lines removed, of n rows that share the key in ``times``."""
    surveyed = cut(survey(docs), "survey")
    similar = similar_sets(docs, *rarity(surveyed), threshold)
    every = surveyed.where("sid is not null").groupBy("sid", "key", "line_no").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n"))
    where = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no", "key"))
    first = every.groupBy("sid").agg(where.alias("at"), F.sum("n").alias("copies"))
    acts = first.join(similar.withColumn("gone", F.lit(True)), "sid", "left").where("gone or copies > 1")
    rows = every.join(acts, "sid").withColumn("stays", F.col("gone").isNull() & (F.col("key") == F.col("at.key")) & (F.col("line_no") == F.col("at.line_no")))
    return rows.select("doc_id", "key", "line_no", (F.col("n") - F.col("stays").cast("long")).alias("times"), "n").where("times > 0")


def line_dedup(docs: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """doc_id, line_no (from 1) of each removed line."""
    out = removals(docs, threshold).select("doc_id", "line_no", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return out.select("doc_id", "line_no")


def keep_lines(docs: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """The documents without the removed lines, with all their columns."""
    gone = cut(removals(docs, threshold), "removals")
    # a key's rows are alike: where only further copies lose a line, the first row keeps it
    acts = gone.groupBy("key").agg(F.sort_array(F.collect_list(F.when(F.col("times") == F.col("n"), F.col("line_no")))).alias("gone"), F.max("n").alias("n"))
    wide = positional(docs)
    text, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1
    keyed = wide.withColumn("key", row_key(F.col(f"c{docs.columns.index('doc_id')}"), F.col(f"c{text}")))
    joined = keyed.join(acts.select("key", "gone"), "key", "left")
    out = joined.drop("key").mapInArrow(_without(text, chars), T.StructType(list(wide.schema)))
    again = gone.where("n > 1").select("key").distinct()
    if not again.isEmpty():
        once = keyed.join(again, "key", "left_semi").dropDuplicates(["key"]).join(acts.select("key", "gone"), "key", "left")
        rest = joined.join(again, "key", "left_anti")
        out = rest.drop("key").unionByName(once.drop("key")).mapInArrow(_without(text, chars), T.StructType(list(wide.schema)))
    return out.toDF(*docs.columns)


def _without(text: int, chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Drops the lines numbered in the last column from the text, and rows that thereby lose all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column(batch.num_columns - 1)
            edit = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False))
            cols, stay = list(batch.columns[:-1]), np.ones(len(batch), bool)
            if len(edit):
                texts, sizes = {}, {}
                for i in edit:
                    numbers = set(gone[int(i)].as_py())
                    kept = [x for k, x in enumerate(cols[text][int(i)].as_py().split("\n"), 1) if k not in numbers]
                    if numbers and not any(vec.word_list(x) for x in kept):
                        stay[i] = False
                    texts[i], sizes[i] = "\n".join(kept), len("\n".join(kept))
                mask = np.zeros(len(batch), bool)
                mask[edit] = True
                cols[text] = pc.replace_with_mask(cols[text], pa.array(mask), pa.array([texts[i] for i in edit], cols[text].type))
                if chars >= 0:
                    cols[chars] = pc.replace_with_mask(cols[chars], pa.array(mask), pa.array([sizes[i] for i in edit], cols[chars].type))
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1]).filter(pa.array(stay))

    return run
