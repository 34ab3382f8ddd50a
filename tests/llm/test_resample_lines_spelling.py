"""Importance resampling, line de-duplication and spelling variants against plain versions on small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from veilscan.llm import crc, importance_resampling, license_scan, line_dedup, repeated_bytes, spelling_variants
from veilscan.llm import context_mixing as cm
from veilscan.llm import words as W

SPACES = " \t\n\v\f\r"


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# --- running CRCs


def test_crc_of_substrings():
    rng = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 65, 1000, 70_000):
        data = rng.integers(0, 256, n).astype(np.uint8)
        sums, raw = crc.running(data), data.tobytes()
        a, b = np.sort(rng.integers(0, n + 1, (2, 100)), axis=0)
        assert crc.between(sums, a, b).tolist() == [zlib.crc32(raw[i:j]) for i, j in zip(a, b, strict=True)]
        first, second = crc.between(sums, a * 0, a), crc.between(sums, a, b)
        assert crc.joined(first, second, b - a).tolist() == [zlib.crc32(raw[:j]) for j in b]


# --- 11 importance resampling


def resampled(rows, target, lengths=(1, 2), buckets=10_000, percent=25, min_words=20, seed=7):
    def grams(text):
        w = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", ascii_lower(text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in lengths for i in range(len(w) - n + 1)]

    own, other = [grams(t) for _, t in rows], Counter(b for t in target for b in grams(t)[1])
    s = Counter(b for _, g in own for b in g)
    s_all, t_all = sum(s.values()), sum(other.values())
    gain = {b: math.floor(1000 * math.log((other[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in s}
    out = []
    for (i, _), (n, g) in zip(rows, own, strict=True):
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_resample(make, spark, odd_rows, seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"Wörd{k}" if k % 3 else f"x{k}-Y" for k in range(60)]
    rows = odd_rows + [(100 + k, " ".join(rng.choice(vocabulary, int(rng.integers(0, 60))))) for k in range(80)]
    target = [" ".join(rng.choice(vocabulary[:15], 40)) for _ in range(5)] + [None, ""]
    other = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    for options in ({}, {"lengths": (1, 2, 3), "buckets": 97, "percent": 60, "min_words": 0}):
        got = importance_resampling.resample(make(rows), other, **options).collect()
        want = resampled(rows, target, **options)
        # rows that repeat score alike, so which of them has which rank is open
        assert Counter(tuple(r)[:5] for r in got) == Counter(tuple(r[:5]) for r in want)
        assert sorted((r.rank, r.doc_id or -1, r.score) for r in got if r.rank) == sorted((r[5], r[0] or -1, r[4]) for r in want if r[5])
    assert importance_resampling.resample(make([]), other).count() == 0
    assert importance_resampling.resample(make(rows), other.limit(0)).where("rank = 1").count() == 1


def test_resample_text_ids(spark):
    rows = [(f"d{k}", f"some words of text {k} " * 6) for k in range(40)]
    got = importance_resampling.resample(spark.createDataFrame(rows, "doc_id string, text string"), spark.createDataFrame([("some text",)], "text string"))
    assert sorted(tuple(r) for r in got.where("rank is not null").select("rank", "doc_id").collect()) == sorted((r[5], r[0]) for r in resampled(rows, ["some text"]) if r[5])


# --- 12 line de-duplication


def without_lines(rows, min_chars=20, min_docs=3):
    def key(line):
        return ascii_lower(line.strip(SPACES))

    holders = defaultdict(list)
    for i, text in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(-math.inf if i is None else i)
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        me = -math.inf if i is None else i
        kept = [x for x in lines if keeper.get(key(x), me) == me]
        out.append((i, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.fixture(scope="module")
def line_rows():
    rng = np.random.default_rng(4)
    shared = [f"A shared line of some length, number {k}" for k in range(30)] + ["short", "", "  \t", "exactly twenty chars", "nineteen characters", "é" * 20, "É" * 20]
    rows = [(None, shared[0]), (None, "only rows without an id hold this line"), (None, "only rows without an id hold this line"), (None, "only rows without an id hold this line")]
    rows += [(1, None), (2, ""), (3, "\n\n"), (3, "\n\n"), (4, "A SHARED line of some length, number 1 \n" * 3), (4, shared[1])]
    for k in range(120):
        lines = [rng.choice(shared) if rng.random() < 0.6 else f"own line of document {k}, {rng.random()}" for _ in range(int(rng.integers(0, 12)))]
        lines = [x.upper() if rng.random() < 0.2 and "é" not in x else f"\t{x} \r" if rng.random() < 0.2 else x for x in lines]
        rows.append((10 + k, "\n".join([*lines, "One line that all documents of the table hold"])))
    rows.append((500, "very long line " * 30_000 + "\n" + shared[2]))
    return rows


def test_lines(make, line_rows, odd_rows):
    for rows in (line_rows, odd_rows):
        docs = make(rows)
        got = line_dedup.without_repeats(docs, counts=("before", "gone"))
        assert got.columns == [*docs.columns, "before", "gone"]
        assert Counter((r.doc_id, r.text, r.before, r.gone) for r in got.collect()) == Counter(without_lines(rows))
    assert line_dedup.without_repeats(make([])).count() == 0
    got = line_dedup.without_repeats(make(line_rows), min_chars=1, min_docs=2).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(r[:2] for r in without_lines(line_rows, 1, 2))


def test_lines_with_a_full_filter(make, line_rows, monkeypatch):
    """A filter of 64 bits lets nearly all lines through and a hot share of 1 moves all to the shuffle; the result is the same."""
    monkeypatch.setattr(line_dedup, "LEAST_BITS", 64)
    monkeypatch.setattr(line_dedup, "MOST_BITS", 64)
    monkeypatch.setattr(line_dedup, "HOT_PART", 1)
    got = line_dedup.without_repeats(make(line_rows)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(r[:2] for r in without_lines(line_rows))


def test_line_filter_has_no_false_negatives(spark, line_rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "SEGMENT", 1 << 12)
    monkeypatch.setattr(line_dedup, "LEAST_BITS", 1 << 16)
    docs = spark.createDataFrame(line_rows, "id long, text string").repartition(7)
    seen = line_dedup.twice_seen(docs.select("text"), 20)
    found = {bytes(r.key) for r in line_dedup.suspects(docs, seen, 20).collect()}
    own = [{ascii_lower(x.strip(SPACES)) for x in (t or "").split("\n")} for _, t in line_rows]
    counts = Counter(hashlib.blake2b(k.encode(), digest_size=16).digest() for some in own for k in some if len(k) >= 20)
    assert {k for k, n in counts.items() if n > 1} <= found
    assert len(found) < 0.5 * len(counts)


def test_packed_places():
    for places in ([], [0], [65534], [65535], [65536], [0, 1, 65535, 65537, 200_000, 1_048_575], [131_070, 131_071, 196_606]):
        assert line_dedup.unpack(line_dedup.pack(np.array(places, dtype=np.int64))).tolist() == places


# --- 13 spelling variants


def spelled(rows, planted=None, min_chars=6, min_count=5, ratio=5):
    counts = Counter()
    for i, text in rows:
        for word in map(ascii_lower, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if planted and h % planted == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= min_chars:
                counts[word] += 1
    return forms({w: n for w, n in counts.items() if n >= min_count}, ratio)


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def forms(counts, ratio=5):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = [w, form, w, n, len(near), counts[form] if form is not None else None]
    for row in out.values():
        while out[row[2]][1] is not None:
            row[2] = out[row[2]][1]
    return sorted(map(tuple, out.values()))


@pytest.mark.parametrize("block", [1024, 8])
def test_spellings(make, odd_rows, monkeypatch, block):
    monkeypatch.setattr(spelling_variants, "BLOCK", block)
    rng = np.random.default_rng(6)
    stems = ["".join(rng.choice(list("abé"), int(rng.integers(5, 9)))) for _ in range(40)] + ["Überzug", "aaaaaaa", "a" * 3000]
    rows = list(odd_rows)
    for k in range(150):
        words = list(rng.choice(stems, 60))
        for j in range(0, 60, 7):
            at = int(rng.integers(0, len(words[j])))
            words[j] = words[j][:at] + rng.choice(["", "x", "é", "bb"]) + words[j][at + 1 :]
        rows.append((20 + k, "-".join(words)))
    for planted in (None, 3):
        got = spelling_variants.group_spellings(make(rows), planted=planted).collect()
        want = spelled(rows, planted)
        assert sorted(tuple(r) for r in got) == want and sum(r[1] is not None for r in want) >= 5
    assert spelling_variants.group_spellings(make([])).count() == 0
    assert spelling_variants.group_spellings(make([(1, None), (2, "")])).count() == 0


def test_spelling_chains(spark):
    """Forms lead on over many words, each five times as frequent as the one before."""
    words, n = ["abcdefgh"], 5
    for k in range(12):
        words.append(words[-1] + "xyz"[k % 3])
    counts = {w: n * 5**k for k, w in enumerate(words)} | {"standing": 7, "aaaaaa": 50, "aaaaab": 50, "aaaaac": 10}
    got = spelling_variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert sorted(tuple(r) for r in got) == forms(counts)
    assert {r.word: r.root for r in got}["abcdefgh"] == words[-1]


def test_near_pairs_dense():
    rng = np.random.default_rng(9)
    words = sorted({"".join(rng.choice(list("ab"), int(rng.integers(6, 9)))) for _ in range(150)})
    found = set()
    for short in range(5, 10):
        for at_start in (1, 0):
            halves = defaultdict(list)
            for w in words:
                if len(w) in (short, short + 1):
                    halves[w[: short // 2] if at_start else w[-(short - short // 2) :]].append(w)
            for own in halves.values():
                full = np.ones(len(own), dtype=np.int64)
                for i, j in zip(*spelling_variants.near_pairs(own, full, 0 * full, full * short, full * at_start), strict=True):
                    pair = (own[i], own[j])
                    assert pair not in found and pair[::-1] not in found
                    found.add(pair)
    assert {frozenset(p) for p in found} == {frozenset((a, b)) for a in words for b in words if a != b and one_edit(a, b)}


def test_word_spans():
    texts = ["Größe×a÷b don't 中文 éà", "", "ÿ", "žĀé"]
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    starts, ends, firsts = spelling_variants.word_spans(data, offs)
    got = W.strings(data, starts, ends).to_pylist()
    assert [got[a:b] for a, b in zip(firsts[:-1], firsts[1:], strict=True)] == [re.findall("[A-Za-zÀ-ÿ]+", t) for t in texts]


# --- names that operators use themselves


def test_cut_with_clashing_columns(spark):
    passage = " ".join(f"word{k}" for k in range(40))
    rows = [(k, f"{k} {passage} {k}", 10 * k, 20 * k, [k], "x", k, "y") for k in range(3)]
    kind = "doc_id long, text string, _id long, _h long, _starts array<int>, _ends string, id long, h string"
    docs = spark.createDataFrame(rows, kind)
    got = {r.doc_id: r for r in repeated_bytes.without_repeats(docs).collect()}
    assert got[0].text == rows[0][1] and got[2].text == "22"
    for row in rows:
        assert tuple(got[row[0]])[2:] == row[2:]
    lines = line_dedup.without_repeats(docs.withColumn("lost", docs.h).withColumn("key", docs.h), min_docs=2)
    assert [tuple(r)[2:] for r in lines.orderBy("doc_id").collect()] == [(*r[2:], "y", "y") for r in rows]


# --- 10 the mixer, one text and one bit after another


def mixed_plainly(tables, hashes, ctx):
    """Natural log of the probability of the class bits of one text, as the operator's description has it."""
    bits = cm.BITS
    weights, curve = (x.astype(float) for x in tables.first())
    seen, ones, total, start = {}, {}, 0.0, 0
    while start < len(hashes):
        run = range(start, min(start + min(cm.RUN, max(1, start)), len(hashes)))
        moves, steps, marks = [], [], []
        for t in run:
            klass = int(hashes[t]) >> (64 - bits)
            for b in range(bits):
                bit = klass >> (bits - 1 - b) & 1
                node = (1 << b) | (klass >> (bits - b))
                spread = (node * 40503) & 0xFFFFFFFF
                where = [node]
                for table in (1, 2):
                    where.append(((int(ctx[table - 1][t]) & 0xFFFFFFFF) ^ spread ^ (spread >> 9)) & (cm.SLOTS[table] - 1))
                where.append((int(ctx[2][t]) >> 58 << bits) | node)
                chance = (ones.get(node, 0) + 2 * float(tables.chances[node])) / (seen.get(node, 0) + 2)
                x = [float(tables.logits[k][w]) for k, w in enumerate(where)] + [math.log(chance / (1 - chance))]
                z = min(7.99, max(-7.99, sum(a * w for a, w in zip(x, weights[:, b], strict=True))))
                p = 1 / (1 + math.exp(-z))
                low = math.floor((z + 8) * 2)
                part = (z + 8) * 2 - low
                final = 0.5 * (p + curve[b, low] * (1 - part) + curve[b, low + 1] * part)
                total += math.log(final if bit else 1 - final)
                moves.append((b, [cm.RATE * (bit - p) * a for a in x]))
                at = low + (part > 0.5)
                steps.append((b, at, (bit - curve[b, at]) / (cm.MAP_STRENGTH + 1)))
                marks.append((node, bit))
        for b, move in moves:
            weights[:, b] += move
        for b, at, step in steps:
            curve[b, at] += step
        for node, bit in marks:
            seen[node], ones[node] = seen.get(node, 0) + 1, ones.get(node, 0) + bit
        start = run.stop
    return total


def test_mixing_side_by_side_equals_one_after_another():
    rng = np.random.default_rng(12)
    logits, chances = cm.logits_of(*rng.integers(0, 30, (2, sum(cm.SLOTS))))
    nothing = np.zeros(0, dtype=np.uint64)
    tables = cm.Tables(logits, chances, np.ones(cm.NODES), nothing, nothing.view(np.int64), True, 0, 0)
    words = [f"w{k}" * (k % 4 + 1) for k in range(40)]
    texts = [" ".join(rng.choice(words, n)).encode() for n in (0, 1, 2, 7, 30, 75)]
    offs = np.cumsum([0, *map(len, texts)])
    hashes, at, short = cm.tokens(np.frombuffer(b"".join(texts), dtype=np.uint8), offs)
    ctx = cm.contexts(hashes, at, short)
    got = cm.mix_texts(tables, hashes, at, short)
    want = [mixed_plainly(tables, hashes[a:b], [c[a:b] for c in ctx]) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == pytest.approx(want, rel=2e-5)


# --- 1 licenses, against all places of all texts


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *row]
        for k, y in enumerate(b):
            row[k] = row[k + 1] + 1 if x == y else max(row[k - 1] if k else 0, row[k + 2])
        row = [0, *row[: len(b)]]
    return row[-1]


def test_longest_common_subsequence():
    assert _lcs("abcde", "xbdye") == 3 and _lcs("", "a") == 0 and _lcs("aab", "ab") == 2


def test_licenses_at_every_place(make):
    """Copies with some words replaced: every place where enough words agree is found, and what is found is no more than agrees."""
    rng = np.random.default_rng(21)
    templates = {k: re.findall("[^\\W_]+", t.lower()) for k, t in license_scan.TEMPLATES.items()}
    rows, planted = [], []
    for k in range(60):
        words = [f"n{x}" for x in rng.integers(0, 500, int(rng.integers(0, 60)))]
        for name in rng.choice(list(templates), int(rng.integers(0, 4)), replace=False):
            copy = list(templates[name])
            for at in rng.choice(len(copy), int(rng.integers(0, 1 + len(copy) // 12)), replace=False):
                copy[at] = f"other{at}"
            planted.append((k, str(name), len(words), copy))
            words += [*copy, *(f"n{x}" for x in rng.integers(0, 500, 20))]
        rows.append((k, " ".join(words)))
    got = license_scan.scan(make(rows)).collect()
    places = {}
    for r in got:
        text = rows[r.doc_id][1]
        own = text[r.span_start : r.span_end].split()
        assert r.coverage >= license_scan.COVERAGE and r.matched_words == round(r.coverage * len(templates[r.license]))
        assert r.matched_words <= _lcs(templates[r.license], own)
        first = len(text[: r.span_start].split())
        places.setdefault((r.doc_id, r.license), []).append((first, first + len(own), r.matched_words))
    for k, name, at, copy in planted:
        same = sum(a == b for a, b in zip(copy, templates[name], strict=True))
        over = [m for a, b, m in places.get((k, name), []) if a < at + len(copy) and b > at]
        assert over and max(over) >= same, (k, name)
    # nothing is found where no place of the text agrees well enough
    for r in got:
        words, own = rows[r.doc_id][1].split(), templates[r.license]
        best = max(sum(a == b for a, b in zip(words[p:], own)) for p in range(len(words)))
        assert best >= 0.5 * license_scan.COVERAGE * len(own)
