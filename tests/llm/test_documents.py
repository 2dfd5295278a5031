"""Quality rules, line dedup, near-dedup, decontamination: odd tables and brute force."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from pageloom.llm import decontaminate, linededup, quality, simhash, smallworld, vec
from pageloom.llm.vec import word_list

from .conftest import EXTRA, ODD, prose, table

KEEPERS = {
    "quality": quality.keep_documents,
    "lines": linededup.keep_lines,
    "simhash": simhash.keep_documents,
}


@pytest.mark.parametrize("name", KEEPERS)
def test_empty_tables_keep_their_columns(empty, name):
    out = KEEPERS[name](empty)
    assert out.columns == empty.columns and out.count() == 0


def rows(df):
    return sorted(((r[0], r[1]) for r in df.collect()), key=repr)


def test_odd_rows_pass_quality(odd):
    out = quality.keep_documents(odd)
    assert out.columns == odd.columns and rows(out) == sorted(ODD, key=repr)
    assert quality.quality_rules(odd).count() == len(ODD)


def test_odd_rows_in_near_dedup(odd):
    lost = sorted((r.doc_id, r.kept_id) for r in simhash.near_duplicates(odd).collect())
    assert lost == [(5, 4), (5, 4)]
    kept = rows(simhash.keep_documents(odd))
    assert kept == sorted([r for r in ODD if r[0] != 5], key=repr)


def test_repeated_rows_leave_one(spark):
    df = table(spark, [(9, prose(3, 50))] * 3 + [(10, prose(4, 50))])
    assert sorted(r.doc_id for r in simhash.near_duplicates(df).collect()) == [9, 9]
    assert sorted(r[0] for r in simhash.keep_documents(df).collect()) == [9, 10]
    assert sorted(r.doc_id for r in linededup.line_dedup(df).collect()) == [9, 9]
    assert sorted(r[0] for r in linededup.keep_lines(df).collect()) == [9, 10]


def test_odd_rows_in_line_dedup(odd):
    assert sorted((r.doc_id, r.line_no) for r in linededup.line_dedup(odd).collect()) == [(5, 1), (5, 1)]
    out = linededup.keep_lines(odd)
    assert out.columns == odd.columns
    assert rows(out) == sorted([r for r in ODD if r[0] != 5], key=repr)


def brute_depths(words, least):
    best = [0] * len(words)
    for i in range(len(words)):
        for j in range(len(words)):
            k = 0
            while i != j and i + k < len(words) and j + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best[i] = max(best[i], k)
    return [d if d >= least else 0 for d in best]


@pytest.mark.parametrize("seed", range(6))
def test_repeats_against_brute_force(seed):
    r = random.Random(seed)
    texts = [" ".join(r.choice(["a", "b", "c"][: 1 + seed % 3]) for _ in range(r.randint(0, 60))) for _ in range(12)] + [None, ""]
    n, covered, longest = quality.measure(pa.array(texts), 4)
    for t, a, b, c in zip(texts, n, covered, longest):
        words = word_list(t)
        depth = brute_depths(words, 4)
        span = {p for i, d in enumerate(depth) for p in range(i, i + d)}
        assert (a, b, c) == (len(words), len(span), max(depth, default=0))


def test_repetitive_texts_are_rejected(spark):
    df = table(spark, [(1, "same ten words that come again and again in a row " * 20), (2, prose(7, 400)), (3, prose(8, 300) + " " + " ".join(prose(9, 250) for _ in range(2)))])
    assert [r[0] for r in quality.keep_documents(df).collect()] == [2]


def brute_lines(docs, p=4, q=9):
    seen, out = [], set()
    for d, t in sorted(docs):
        for k, line in enumerate((t or "").split("\n"), 1):
            s = frozenset(word_list(line))
            if s:
                if any(q * len(s & o) >= p * (len(s) + len(o)) for o in seen):
                    out.add((d, k))
                seen.append(s)
    return out


@pytest.mark.parametrize("seed,best", [(0, (1, 1)), (1, (1, 3)), (2, (2, 12))])
def test_line_dedup_against_brute_force(spark, monkeypatch, seed, best):
    r = random.Random(seed)
    monkeypatch.setattr(linededup, "RARE", 2)  # so that words count as frequent and pairs become keys
    monkeypatch.setattr(linededup, "BEST", best)
    vocabulary = [f"w{k}" for k in range(60)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(1, 25))] for _ in range(40)]
    docs = []
    for d in range(40):
        lines = []
        for _ in range(r.randint(1, 6)):
            words = list(r.choice(base))
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            lines.append(" ".join(words))
        docs.append((d, "\n".join(lines)))
    got = {(x.doc_id, x.line_no) for x in linededup.line_dedup(table(spark, docs)).collect()}
    assert got == brute_lines(docs)


def test_line_dedup_over_the_small_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {(x.doc_id, x.line_no) for x in linededup.line_dedup(docs).collect()}
    assert got == brute_lines([(r.doc_id, r.text) for r in docs.collect()])


def flips(r, sig, share):
    return sig ^ np.packbits(r.random((len(sig), 256)) < share, axis=1).view(np.uint64)


def test_hot_keys_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HOT", 6)
    monkeypatch.setattr(linededup, "SAMPLE", 2)
    monkeypatch.setattr(linededup, "BEST", (1, 1))
    r = random.Random(8)
    base = [f"word{k}" for k in range(12)]
    docs = []
    for d in range(60):  # one family that differs by up to three words of twelve, so matches are some near, some not
        words = list(base)
        for k in r.sample(range(12), r.randint(0, 3)):
            words[k] = f"other{r.randint(0, 20)}"
        docs.append((d, " ".join(words) + "\n" + prose(d, 6)))
    df = table(spark, docs)
    surveyed = linededup.survey(df)
    assert linededup.hot_keys(df, *linededup.rarity(surveyed), linededup.THRESHOLD)[1] > 1
    assert {(x.doc_id, x.line_no) for x in linededup.line_dedup(df).collect()} == brute_lines(docs)


@pytest.mark.parametrize("held,best", [(1 << 22, None), (1 << 22, (1, 2)), (5, (1, 2)), (5, (3, 40))])
def test_candidates_are_all_pairs_or_the_closest(monkeypatch, held, best):
    monkeypatch.setattr(linededup, "_HELD", held)
    monkeypatch.setattr(linededup, "_PAIRS", 7)
    monkeypatch.setattr(linededup, "WIDE", 10)
    r, t = random.Random(5), Fraction(4, 5)
    base = [r.randrange(1 << 64) for _ in range(20)]
    sets = {frozenset(r.sample(base, r.randint(6, 15))) for _ in range(60)}
    sets = [sorted(s) for s in sets]
    h, bounds = np.array([w for s in sets for w in s], np.uint64), np.r_[0, np.cumsum([len(s) for s in sets])]
    bit = np.uint64(1) << (h & np.uint64(63))
    parity = np.bitwise_xor.reduceat(bit, bounds[:-1])
    more = np.bitwise_xor.reduceat(np.where(h & np.uint64(64), bit, np.uint64(0)), bounds[:-1])
    size = np.diff(bounds)
    more[size <= 10] = 0
    sid, key = np.arange(len(sets)), np.arange(len(sets)) % 2
    cols = [key, sid, np.arange(len(sets)) * 7 % 61, np.ones(len(sets), np.int64), size << 32, parity.view(np.int64), more.view(np.int64)]
    got, short = {}, set()
    for later, earlier, k in linededup._candidates(cols, t, best):
        short |= {(int(a), int(b)) for a, b in zip(later, k)} if not len(earlier) else set()
        for a, b in zip(later.tolist(), earlier.tolist()):
            got.setdefault(a, set()).add(b)
    doc = cols[2]
    for a in sid.tolist():
        mates = [b for b in sid.tolist() if key[b] == key[a] and doc[b] < doc[a]]
        similar = {b for b in mates if 9 * len({*sets[a]} & {*sets[b]}) >= 4 * (size[a] + size[b])}
        if best is None or not any(x == a for x, _ in short):
            assert similar <= got.get(a, set())
        else:
            assert len(got[a]) in best


@pytest.mark.parametrize("seed", range(3))
def test_small_world_recall(seed):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**63, (1500, 4), dtype=np.int64).view(np.uint64)
    near = flips(r, base[r.integers(0, 1500, 300)], 0.12)
    crowd = flips(r, np.repeat(base[:1], 120, axis=0), 0.05)
    sig = np.concatenate([base, near, crowd])[r.permutation(1920)]
    pairs = smallworld.exact_pairs(sig, simhash.RADIUS)
    root = smallworld.neighbours(sig, simhash.RADIUS).all()
    assert (root[pairs[:, 0]] == root[pairs[:, 1]]).mean() >= 0.9
    exact = smallworld.Groups(len(sig))
    exact.union(pairs[:, 0], pairs[:, 1])
    whole = exact.all()
    assert (whole[root] == whole).all()  # nothing is grouped that isn't connected


@pytest.mark.parametrize("sizes", [(50, 50), (50, 70, 90)])
def test_crowds_that_fill_each_beam_are_joined(sizes):
    r = np.random.default_rng(8)
    flipped = lambda s, bits: s ^ np.packbits(np.bincount(r.permutation(256)[:bits], minlength=256).astype(np.uint8)).view(np.uint64)
    heart, sig = r.integers(0, 2**63, 4, dtype=np.int64).view(np.uint64), []
    for size in sizes:  # members lie 10 bits apart, and 40 or so from those of the family before
        sig += [flipped(heart, 5) for _ in range(size)]
        heart = flipped(heart, 32)
    far = r.integers(0, 2**63, (5, 4), dtype=np.int64).view(np.uint64)
    root = smallworld.neighbours(np.concatenate([np.stack(sig), far]), simhash.RADIUS).all()
    assert len(set(root[: sum(sizes)])) == 1 and len(set(root)) == 6


def test_signature_against_plain_python():
    texts = [prose(5, 40), "two words", "one", "", None, "a b " * 70000]
    sig, count = simhash.signature(pa.array(texts))
    for t, s, n in zip(texts, sig, count):
        words = word_list(t)
        pairs = {(a, b) for a, b in zip(words, words[1:])} or {(w,) for w in words}
        assert n == len(pairs)
        assert n or not s.any()


def test_near_dedup_recall_and_clean_documents(spark):
    r = random.Random(1)
    docs = []
    for k in range(60):
        words = prose(100 + k, r.randint(60, 400)).split()
        docs.append((10 * k, " ".join(words)))
        for c in range(k % 3):
            copy = list(words)
            for _ in range(len(copy) // 25):
                copy[r.randrange(len(copy))] = "changed"
            docs.append((10 * k + c + 1, " ".join(copy)))
    df = table(spark, docs)
    lost = {x.doc_id: x.kept_id for x in simhash.near_duplicates(df, shard=32).collect()}
    copies = {d for d, _ in docs if d % 10}
    assert set(lost) <= copies and len(lost) >= 0.9 * len(copies) and all(lost[d] == d - d % 10 for d in lost)
    audit = simhash.recall_audit(df, shard=32).first()
    assert audit.pairs > 0 and audit.found >= 0.9 * audit.pairs


def test_pairs_at_the_radius_meet_at_any_count(spark):
    r = np.random.default_rng(5)
    a = r.integers(-(2**63), 2**63, (100, 4), dtype=np.int64).view(np.uint64)
    b = a ^ np.packbits(r.permuted(np.repeat([[1] * simhash.RADIUS + [0] * (256 - simhash.RADIUS)], 100, axis=0), axis=1).astype(np.uint8), axis=1).view(np.uint64)
    nodes = spark.createDataFrame([(k, *map(int, s.view(np.int64))) for k, s in enumerate(np.concatenate([a, b]))], "node long, s0 long, s1 long, s2 long, s3 long")
    # sixteen shards in a table, as 4 million nodes have
    found = {(x.a % 100, x.b % 100) for x in simhash.near_edges(nodes, 200, shard=12).collect()}
    assert all(x == y for x, y in found) and len(found) >= 0.95 * 100


@pytest.mark.parametrize("count", [0, 1, 10**5, 10**7, 10**9, 4 * 10**10])
def test_tables_follow_the_count(count):
    missed = (1 - smallworld.FOUND * simhash.meeting(count)) ** simhash.table_count(count)
    assert missed <= 1 - simhash.MEET


@pytest.mark.parametrize("n", [3000, 20000])
def test_lone_pairs_at_the_radius_are_found_in_a_shard(n):
    r = np.random.default_rng(n)
    base = r.integers(0, 2**63, (n, 4), dtype=np.int64).view(np.uint64)
    at = np.packbits(r.permuted(np.repeat([[1] * simhash.RADIUS + [0] * (256 - simhash.RADIUS)], 500, axis=0), axis=1).astype(np.uint8), axis=1).view(np.uint64)
    root = smallworld.neighbours(np.concatenate([base, base[:500] ^ at]), simhash.RADIUS).all()
    assert (root[:500] == root[n:]).mean() >= 0.92  # FOUND less what chance takes


def test_a_node_near_few_members_of_a_crowd_joins_it():
    r = np.random.default_rng(9)
    flipped = lambda s, bits: s ^ np.packbits(np.bincount(r.permutation(256)[:bits], minlength=256).astype(np.uint8)).view(np.uint64)
    heart = r.integers(0, 2**63, 4, dtype=np.int64).view(np.uint64)
    crowd, lone = np.stack([flipped(heart, 8) for _ in range(3000)]), np.stack([flipped(heart, 60) for _ in range(40)])
    far = r.integers(0, 2**63, (3000, 4), dtype=np.int64).view(np.uint64)
    root = smallworld.neighbours(np.concatenate([crowd, far, lone]), simhash.RADIUS).all()
    near = np.array([smallworld.hamming(crowd, x).min() <= simhash.RADIUS for x in lone])
    assert len(set(root[:3000])) == 1 and near.sum() > 20 and (root[6000:][near] == root[0]).mean() >= 0.9


def brute_infix(a, b):
    prev = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return min(prev)


@pytest.mark.parametrize("seed", range(20))
def test_infix_distance(seed):
    r = random.Random(seed)
    a, b = ([r.randint(0, 3) for _ in range(r.randint(1, 9))] for _ in range(2))
    got, first = decontaminate.infix_distance(np.array(a, np.uint64), np.array(b, np.uint64))
    assert got == brute_infix(a, b) and 0 <= first <= len(b)


def items_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_decontamination_against_brute_force(spark):
    r = random.Random(4)
    items = [(k, prose(500 + k, r.randint(14, 40))) for k in range(25)] + [(90, None), (91, "")]
    docs, planted = [], set()
    for d in range(120):
        words = prose(900 + d, 120).split()
        if d % 2:
            k, text = items[r.randrange(25)]
            leak = text.split()
            for _ in range(int(0.15 * len(leak)) if d % 4 == 1 else 0):
                leak[r.randrange(len(leak))] = "edited"
            words[50:50] = leak
            planted.add((d, k))
        docs.append((d, " ".join(words)))
    got = {(x.doc_id, x.item_id): x.edits for x in decontaminate.contaminated(table(spark, docs), items_table(spark, items)).collect()}
    brute = {(d, k): e for d, t in docs for k, i in items if i for e in [brute_infix(word_list(i), word_list(t))] if e <= int(0.15 * len(word_list(i)))}
    assert planted <= set(brute) and set(got) <= set(brute)
    assert len(got) >= 0.95 * len(brute) and all(got[x] >= brute[x] for x in got)
    kept = {x[0] for x in decontaminate.keep_documents(table(spark, docs), items_table(spark, items)).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_decontamination_of_odd_and_empty_tables(spark, odd, empty):
    items = items_table(spark, [(1, "alone with no id here at all"), (2, None)])
    assert [(x.doc_id, x.item_id, x.edits) for x in decontaminate.contaminated(odd, items).collect()] == [(None, 1, 0)]
    assert decontaminate.keep_documents(odd, items).count() == len(ODD) - 1
    none = items_table(spark, [])
    assert decontaminate.contaminated(odd, none).count() == 0
    assert decontaminate.keep_documents(odd, none).count() == len(ODD)
    assert decontaminate.contaminated(empty, items).count() == 0


@pytest.mark.parametrize("kind", ["int", "long", "string", "short"])
def test_item_ids_of_any_type(spark, kind):
    text = prose(61, 20)
    items = spark.createDataFrame([("7" if kind == "string" else 7, text)], f"item_id {kind}, text string")
    out = decontaminate.contaminated(table(spark, [(1, f"before {text} after"), (2, prose(62, 30))]), items)
    assert out.schema["item_id"].dataType.simpleString() == items.schema["item_id"].dataType.simpleString()
    assert [(str(r.item_id), r.doc_id) for r in out.collect()] == [("7", 1)]


def test_a_short_item_leaves_the_search_for_others_alone():
    r = random.Random(3)
    words = lambda n: np.array([r.randrange(1 << 64) for _ in range(n)], np.uint64)
    long = [(k, words(20 + k)) for k in range(10)]
    alone, mixed = decontaminate.plans(long), decontaminate.plans([*long, (98, words(1)), (99, words(3))])
    assert [p.window for p in mixed] == [1, 2, 16] and [p.window for p in alone] == [16]
    assert [d[0] for d in mixed[-1].draws] == [d[0] for d in alone[0].draws]


def test_an_unmet_recall_is_an_error(monkeypatch):
    monkeypatch.setattr(decontaminate, "REPS", 1)
    words = np.arange(40, dtype=np.uint64) * np.uint64(7919)
    with pytest.raises(ValueError):
        decontaminate.Plan([(1, words)], edits=0.3, recall=1.0)


def test_slices_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE", 20)
    items = [(k, prose(40 + k, 15)) for k in range(6)]
    docs = table(spark, [(k, prose(70 + k, 20) + " " + t) for k, t in items])
    assert sorted((x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, items_table(spark, items)).collect()) == [(k, k) for k in range(6)]


@pytest.mark.parametrize("text", ["Ünïted STATES, 3x!", "", None, "ß é Ñandú\nzwei", "x" * 100])
def test_word_hashes_follow_the_word_rule(text):
    h, _, bounds = vec.words(*vec.flat(pa.array([text])))
    words = word_list(text)
    assert bounds[-1] == len(words) == len(h)
    again = vec.words(*vec.flat(pa.array([" ".join(words)])))[0]
    assert (h == again).all()


def test_threshold_is_a_fraction():
    assert linededup.THRESHOLD == Fraction(4, 5) and EXTRA
