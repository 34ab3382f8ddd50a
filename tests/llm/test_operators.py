"""Each operator against a plain version on a small input with odd rows."""

import hashlib
import zlib
from collections import Counter
from math import log10

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from veilscan.llm import (
    byte_bpe,
    chat_snapshots,
    context_mixing,
    decontaminate,
    jaccard_groups,
    license_scan,
    pu_quality,
    quality_rules,
    queries,
    repeated_bytes,
    token_files,
)
from veilscan.llm import words as W


def same_id(rows):
    """Rows grouped by id, for tables where an id repeats."""
    return Counter((r[0], *r[1:]) for r in rows)


# --- 1 license scan


def test_licenses(make):
    mit = license_scan.TEMPLATES["mit-grant"]
    edited = mit.replace("charge", "any charge").replace("merge, ", "")
    rows = [
        (1, "intro é. Released under the MIT License. outro"),
        (2, f"a b c {edited} d e f"),
        (3, "All rights reserved. x y All rights reserved!"),
        (4, None),
        (5, ""),
        (6, "licensed software under an apache"),
        (7, "filler text here " * 20000 + "Licensed under CC BY-NC 4.0."),
    ]
    got = license_scan.scan(make(rows)).collect()
    found = sorted((r.doc_id, r.license) for r in got)
    assert found == [(1, "mit-line"), (2, "mit-grant"), (3, "all-rights-reserved"), (3, "all-rights-reserved"), (7, "cc-by-nc-4.0-line")]
    texts = dict(rows)
    one = next(r for r in got if r.doc_id == 1)
    assert texts[1][one.span_start : one.span_end] == "Released under the MIT License" and one.coverage == 1.0
    two = next(r for r in got if r.doc_id == 2)
    assert texts[2][two.span_start : two.span_end] == edited.rstrip(":") and two.coverage > 0.95
    assert license_scan.scan(make([])).count() == 0


def test_long_licenses_with_repeated_phrases(make):
    rng = np.random.default_rng(5)
    phrases = ["of the License", "the Work or Derivative Works", "this License and the", "shall mean the"]
    words = []
    while len(words) < 1500:
        words += [*(f"w{k}" for k in rng.integers(0, 300, 4)), *phrases[int(rng.integers(4))].split()]
    light = list(words)
    for k in range(100, 1400, 130):
        light[k] = f"changed{k}"
    del light[700], light[300]
    light.insert(500, "added")
    notice = license_scan.TEMPLATES["apache-2.0-notice"]
    rows = [(1, "a b " + " ".join(words) + " c"), (2, "x " + " ".join(light)), (3, " ".join(words[:600])), (4, notice), (5, f"{notice} - {notice}")]
    got = sorted(tuple(r)[:3] for r in license_scan.scan(make(rows), {"long": " ".join(words), "notice": notice}).collect())
    assert got[0] == (1, "long", len(words)) and got[1][:2] == (2, "long") and 1480 < got[1][2] < 1490
    n = len(license_scan.Index({"notice": notice}).words[0])
    assert got[2:] == [(4, "notice", n), (5, "notice", n), (5, "notice", n)]


def test_repeated_notices(make):
    lines = ["All rights reserved.", "Released under the MIT License.", license_scan.TEMPLATES["cc-by-4.0"]]
    rows = [(k, "\n".join([line] * 10)) for k, line in enumerate(lines)]
    rows.append((3, "Released under the MIT. Released under the MIT License. under the MIT License"))
    got = license_scan.scan(make(rows)).collect()
    for k, line in enumerate(lines):
        spans = sorted((r.span_start, r.span_end) for r in got if r.doc_id == k and r.coverage == 1.0)
        assert spans == [(i * (len(line) + 1), i * (len(line) + 1) + len(line) - 1) for i in range(10)]
    assert sorted(r.matched_words for r in got if r.doc_id == 3) == [4, 4, 5]


def test_alignment_counts_matches():
    rng = np.random.default_rng(3)
    for _ in range(50):
        template = rng.integers(0, 50, 20).astype(np.uint64)
        text = np.concatenate([rng.integers(100, 200, 5), template[:8], [300], template[9:]]).astype(np.uint64)
        assert license_scan.align(template, text, 5, 6) == (19, 5, 25)


# --- 2 chat snapshots


def test_snapshots(spark):
    logs = {
        1: ["a", "b"],
        2: ["a", "b", "c"],
        3: ["a", "b", "c"],
        4: ["a"],
        5: ["x", "b", "c"],
        6: ["a", "c"],
        7: [None, "b"],
        8: ["", "b", "c"],
    }
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", text, 1) for c, turns in logs.items() for t, text in enumerate(turns)]
    rows += [(9, None, None, None, 1), (9, 5, "user", "b", 1), (9, 5, "user", "b", 1)]
    rows += [(10, t * 300, "user", str(t), 1) for t in range(5)] + [(11, t * 300, "user", str(t), 1) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position int")
    got = chat_snapshots.collapse(df).collect()
    kept = {r.conv_id: (r.n_turns, r.n_logs) for r in got}
    assert kept == {2: (3, 2), 5: (3, 1), 6: (2, 1), 7: (2, 1), 8: (3, 1), 9: (3, 1), 10: (5, 1)}
    two = [r.rendered for r in sorted(got, key=lambda r: r.position) if r.conv_id == 2]
    assert "".join(two) == "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n<|user|>\nc<|end|>\n<|eot|>"
    assert chat_snapshots.collapse(df.where("false")).count() == 0
    plan = chat_snapshots.collapse(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 3 quality classifier


def test_classifier_on_held_out_rows(spark, make, odd_rows):
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(300)]
    good = [(10_000 + i, " ".join(rng.choice(vocabulary, 80))) for i in range(400)]
    bad = [(20_000 + i, " ".join(w + "###" for w in rng.choice(vocabulary, 80))) for i in range(100)]
    docs = make(good + bad + odd_rows[:4])
    featured = pu_quality.featurise(docs)
    model = pu_quality.train(featured, spark.createDataFrame([(10_000 + i,) for i in range(0, 300, 2)], "id long"), pu_quality.F.lit(True))
    assert 0.6 < model.prior < 0.95
    scores = {r.id: r.score for r in pu_quality.score(featured, model).collect()}
    assert np.mean([scores[10_000 + i] >= 0.3 for i in range(301, 400)]) > 0.98
    assert np.mean([scores[20_000 + i] < 0.3 for i in range(100)]) > 0.95
    assert all(0 <= s <= 1 for s in scores.values()) and len(scores) == 504
    untrained = pu_quality.train(featured, spark.createDataFrame([], "id long"), pu_quality.F.lit(True))
    assert {r.score for r in pu_quality.score(featured, untrained).collect()} == {0.5}
    assert pu_quality.featurise(make([])).count() == 0


# --- 4 quality rules


def test_rules(make, odd_rows):
    more = [(20, "a b c d e f g h " * 10), (21, "one two\nthree four\none two\n\n \none two" + " w" * 30), (22, "#$ <x> é" * 9)]
    rows = odd_rows + more
    limits, line = quality_rules.NGRAM_LIMITS, quality_rules.LINE_LIMIT
    got = quality_rules.judge(quality_rules.repetition(make(rows)))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert same_id(got.select(names).collect()) == Counter((i, *brute.rules(t, limits, line)) for i, t in rows)
    kept = quality_rules.kept_rows(make(rows)).collect()
    assert Counter(r.doc_id for r in kept) == Counter(i for i, t in rows if brute.rules(t, limits, line)[-1])
    assert quality_rules.repetition(make([])).count() == 0


# --- 5 token files


def test_token_files(spark, make, odd_rows, folder):
    path, tokenizer = f"{folder}/tokens", public_tokenizers.path(token_files.TOKENIZER)
    token_files.write(make(odd_rows), path, tokenizer)
    plain = Tokenizer.from_file(tokenizer)
    want = Counter((i, tuple(plain.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in odd_rows)
    got = token_files.read(spark, path).join(token_files.starts(spark, path), ["file", "block"]).collect()
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    ordered = sorted(got, key=lambda r: r.first + r.at)
    ids = [r.doc_id for r in ordered]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in ordered:
        assert r.first + r.at == at
        at += len(r.ids) // 4
    token_files.write(make([]), f"{folder}/none", tokenizer)
    assert token_files.read(spark, f"{folder}/none").count() == 0


@pytest.mark.parametrize("symbols", [1, 2, 3, 700, 49000])
def test_codes_round_trip(symbols):
    rng = np.random.default_rng(symbols)
    counts = np.floor(rng.pareto(0.7, symbols) * 3).astype(np.int64) + 1
    lengths = token_files.code_lengths(counts)
    assert lengths.max() <= token_files.LONGEST and (0.5 ** lengths.astype(float)).sum() <= 1 + 1e-12
    ids, cuts = rng.integers(0, symbols, 5000), np.array([0, 0, 1, 64, 128, 4000, 5000])
    bits, _, runs, _ = token_files.pack(ids, cuts, lengths, token_files.canonical(lengths))
    table = token_files.decode_table(lengths)
    assert (token_files.unpack(bits.tobytes(), runs.tobytes(), np.diff(cuts), table) == ids).all()


# --- 6 n-gram Jaccard join


def variants(n=60, seed=1):
    """Chains of texts that differ by a few words, copies, short texts and others."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    out, i = [], 0
    for _ in range(6):
        text = list(rng.choice(vocabulary, 90))
        for _ in range(n // 6):
            out.append((i, " ".join(text)))
            i += 1
            for _ in range(int(rng.integers(0, 3))):
                text[int(rng.integers(0, len(text)))] = str(rng.choice(vocabulary))
    common = list(rng.choice(vocabulary, 60))
    for _ in range(20):
        out.append((i, " ".join([*rng.choice(vocabulary, 15), *common, *rng.choice(vocabulary, 15)])))
        i += 1
    return out + [(i, "a b"), (i + 1, "A  B"), (i + 2, "a b c d e"), (i + 3, None), (i + 4, ""), (i + 5, "b a")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_classes(make, seed):
    rows = variants(seed=seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups.classes(make(rows)).collect()}
    label = brute.components(rows)
    assert got == {i: (len(brute.shingles(t)), label[i]) for i, t in rows}
    assert len(set(label.values())) < len(rows) - 20


def test_classes_of_odd_rows(make, odd_rows):
    got = same_id(jaccard_groups.classes(make(odd_rows)).select("doc_id", "component_id").collect())
    assert got == Counter([(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (5, 4), (None, None), (7, 7), (8, 4), (9, 9)])
    assert jaccard_groups.classes(make([])).count() == 0


# --- 7 repeated bytes


def test_repeats(make):
    rng = np.random.default_rng(5)
    passages = ["".join(chr(c) for c in rng.integers(97, 110, 150)) + "é" for _ in range(4)]
    rows = [(i, " ".join(passages[int(k)][int(rng.integers(0, 60)) :] + str(rng.integers(0, 99)) for k in rng.integers(0, 4, 3))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "short"), (53, "ab" * 300), (54, "ab" * 45), (-5, passages[0])]
    gone = brute.repeated(rows)
    got = {r.doc_id: r for r in repeated_bytes.deduplicate(make(rows)).collect()}
    for i, t in rows:
        flags = np.frombuffer(bytes(gone[i]), np.uint8)
        raw = np.frombuffer((t or "").encode(), np.uint8)
        assert bytes(got[i].kept) == raw[flags == 0].tobytes()
        assert got[i].n_removed == flags.sum() == sum(e - s for s, e in zip(got[i].starts, got[i].ends, strict=True))
        assert got[i].n_bytes == len(raw)


def test_repeats_of_odd_rows(make, odd_rows):
    got = [(r.doc_id, len(r.kept)) for r in repeated_bytes.deduplicate(make(odd_rows)).collect()]
    size = len(odd_rows[3][1])
    assert Counter(got)[(4, size)] == 1 and Counter(got)[(5, 0)] == 2 and (None, 17) in got and (1, 0) in got
    assert repeated_bytes.deduplicate(make([])).count() == 0


def test_merge_of_many_shards_and_long_texts():
    rng = np.random.default_rng(0)
    segments = [bytes(rng.integers(97, 99, rng.integers(12, 60)).astype(np.uint8)) for _ in range(200)]
    doc, place = repeated_bytes.repeats(segments, np.arange(200), np.zeros(200, dtype=np.int64), 12, shard=300)
    seen, want = set(), set()
    for i, t in enumerate(segments):
        for s in range(len(t) - 11):
            if t[s : s + 12] in seen:
                want.add((i, s))
            seen.add(t[s : s + 12])
    assert set(zip(doc.tolist(), place.tolist(), strict=True)) == want
    text = rng.integers(97, 123, (1 << 22) + 5000).astype(np.uint8)
    found = repeated_bytes.runs(text, np.array([0, len(text)]))
    sizes = found["far"] - found["near"] + 1
    assert sizes.sum() == len(text) - 99 and (np.diff(found["first"]) == sizes[:-1]).all()


# --- 8 byte-level BPE


def test_bpe(make, odd_rows):
    entries = byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.RANKS))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={e: k for k, e in enumerate(entries)}, special_tokens={})
    rng = np.random.default_rng(2)
    letters = list(" \n\t  ab cdé'sll1234 .,!# 　ßñ中文😀́\x1c\x85")
    rows = odd_rows + [(100 + k, "".join(rng.choice(letters, int(rng.integers(0, 60))))) for k in range(2000)]
    coded = byte_bpe.encode(make(rows), public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN)
    got = Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in coded.collect())
    assert got == Counter((i, tuple(plain.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    empty = byte_bpe.digest(coded).where("doc_id = 1").first()
    assert empty.n_tokens == 0 and empty.ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert byte_bpe.encode(make([]), public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN).count() == 0


def test_bpe_of_white_space_between_texts():
    entries = [bytes([k]) for k in range(256)] + [b"  ", b"ab", b"   "]
    plain = tiktoken.Encoding("runs", pat_str=public_tokenizers.PATTERN, mergeable_ranks={e: k for k, e in enumerate(entries)}, special_tokens={})
    texts = ["ab  ", "ab", "", " ", "\n ", "", "ab   ", "   ", " ab", "ab  "]
    data, offs = W.texts(pa.array(texts))
    ids, at = byte_bpe.Codec(entries, public_tokenizers.PATTERN).encode(data, offs)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [plain.encode_ordinary(t) for t in texts]


# --- 9 decontamination


def test_tiles_against_plain_tiling():
    rng = np.random.default_rng(4)
    for _ in range(60):
        item, text = rng.integers(0, 6, 25), rng.integers(0, 6, 40)
        laid = decontaminate.tiles(item.astype(np.uint64), text.astype(np.uint64), 3)
        assert sum(t[2] for t in laid) == brute.tile(item.tolist(), text.tolist())


def test_leaks(spark, make, odd_rows):
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew strong potions"
    w = item.split()
    reordered = " ".join(w[8:] + ["and", "then"] + w[:8])
    rows = [(21, f"x y {item.upper()} z"), (22, f"é {reordered} end"), (23, " ".join(w[:6]) + " other things"), (24, f"{item} {item}")] + odd_rows
    bench = spark.createDataFrame([(1, item, 0), (2, "tiny one", 0), (3, None, 0), (4, "", 0)], "item_id long, text string, doc_id int")
    got = decontaminate.contaminated(make(rows), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(21, 1), (22, 1), (24, 1)]
    two = next(r for r in got if r.doc_id == 22)
    assert two.n_tiles == 2 and two.coverage == 1.0
    parts = [dict(rows)[22][t.start : t.end] for t in two.tiles]
    assert parts == [" ".join(w[8:]), " ".join(w[:8])]
    blocks = decontaminate.contaminated(make(rows), bench, block_bytes=30).collect()
    assert sorted((r.doc_id, r.item_id) for r in blocks) == [(21, 1), (22, 1), (24, 1)]
    assert decontaminate.clean_rows(make(rows), bench).count() == len(rows) - 3
    assert decontaminate.contaminated(make([]), bench).count() == 0
    assert decontaminate.contaminated(make(rows), bench.where("false")).count() == 0


# --- 10 language-model scores


@pytest.mark.parametrize("tier", [1 << 20, 50, 0])
def test_scores(make, odd_rows, monkeypatch, tier):
    monkeypatch.setattr(context_mixing, "TIER", tier)
    rng = np.random.default_rng(7)
    vocabulary = [f"w{k}" for k in range(120)]
    train = [(i, " ".join(rng.choice(vocabulary, 70, p=np.arange(1, 121) / 7260))) for i in range(80)]
    tables, counts = context_mixing.learn(make(train))
    known = Counter(w for _, t in train for w in [*brute.words(t), None])
    total, distinct = sum(known.values()), len(known)
    assert (tables.total, tables.distinct) == (total, distinct) and counts.count() == distinct
    rows = odd_rows + [(200 + k, " ".join(rng.choice(vocabulary, 300))) for k in range(5)]
    for r in context_mixing.score(make(rows), tables, counts).collect():
        texts = [t for i, t in rows if i == r.doc_id]
        w = [*brute.words((texts[0] or "").translate(brute.LOWER)), None]
        assert r.n_tokens == len(w) and r.n_known == sum(known[x] > 0 for x in w)
        assert r.base_score == pytest.approx(sum(log10((known[x] + 1) / (total + distinct + 1)) for x in w))
        assert r.score < 0 and np.isfinite(r.bits_per_byte)
    empty, none = context_mixing.learn(make([]))
    assert none.count() == 0 and context_mixing.score(make(rows), empty, none).count() == len(rows)


def test_class_bits_are_a_distribution():
    """The bits of all classes that could follow a beginning add up to 1."""
    rng = np.random.default_rng(1)
    zeros, ones = rng.integers(0, 9, sum(context_mixing.SLOTS)), rng.integers(0, 9, sum(context_mixing.SLOTS))
    logits, chances = context_mixing.logits_of(zeros, ones)
    tables = context_mixing.Tables(logits, chances, np.ones(context_mixing.NODES), np.zeros(0, np.uint64), np.zeros(0, np.int64), True, 0, 0)
    start = rng.integers(0, 1 << 63, 70).astype(np.uint64)
    n = context_mixing.NODES
    follow = (np.arange(n, dtype=np.uint64) << np.uint64(64 - context_mixing.BITS)) + np.uint64(5)
    texts = np.concatenate([np.concatenate([start, [f]]) for f in follow])
    at = np.arange(n + 1) * (len(start) + 1)
    short = np.zeros(len(texts), dtype=bool)
    logs = context_mixing.mix_texts(tables, texts, at, short)
    alone = context_mixing.mix_texts(tables, start, np.array([0, len(start)]), short[: len(start)])
    assert np.exp(logs - alone).sum() == pytest.approx(1, abs=2e-3)


def _even(**further):
    """Tables of an empty corpus."""
    n = sum(context_mixing.SLOTS)
    logits, chances = context_mixing.logits_of(np.zeros(n), np.zeros(n))
    none = np.zeros(0, np.uint64)
    return context_mixing.Tables(logits, chances, np.ones(context_mixing.NODES), none, none.view(np.int64), True, 0, 0, **further)


def test_short_texts_are_mixed_online():
    word = np.full(40, 0x1234_5678_9ABC_DEF0, dtype=np.uint64)
    sizes = np.array([5, 10, 20, 40])
    at = np.concatenate([[0], np.cumsum(sizes)])
    logs = context_mixing.mix_texts(_even(), np.tile(word, 2)[: at[-1]], at, np.zeros(at[-1], dtype=bool))
    each = logs / sizes
    # a word that comes again is cheaper each time, in texts of any length
    assert (np.diff(each) > 0.05 * -each[:-1]).all()


def test_weights_and_map_are_learned(make, odd_rows):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(40)]
    follow = {w: rng.choice(vocabulary, 2) for w in vocabulary}

    def text():
        words = [str(rng.choice(vocabulary))]
        while len(words) < 50:
            words.append(str(rng.choice(follow[words[-1]])))
        return " ".join(words)

    tables, counts = context_mixing.learn(make([(i, text()) for i in range(400)] + odd_rows))
    weights, curve = tables.first()
    start, identity = _even().first()
    assert weights.shape == start.shape and curve.shape == identity.shape and np.isfinite(weights).all()
    assert ((curve > 0) & (curve < 1)).all() and not np.allclose(weights, start) and not np.allclose(curve, identity)
    rows = make([(i, text()) for i in range(30)])
    taught = sum(r.score for r in context_mixing.score(rows, tables, counts).collect())
    tables.weights = tables.curve = None
    assert taught > sum(r.score for r in context_mixing.score(rows, tables, counts).collect())
    empty, _ = context_mixing.learn(make([]))
    assert np.allclose(empty.first()[0], start) and np.allclose(empty.first()[1], identity)


# --- shared parts and registered queries


def test_words_of_a_batch():
    texts = ["a  b\tc", None, "", "\x0bx y", "Ä B"]
    data, offs = W.texts(pa.array(texts))
    starts, ends, firsts = W.spans(data, offs)
    got = [[data[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(firsts, firsts[1:])]
    assert got == [brute.words(t) for t in texts]
    assert W.lower(np.frombuffer("Ä B".encode(), np.uint8)).tobytes().decode() == "Ä b"


def test_fold_of_held_out_rows(spark, sf_dir):
    got = queries.QUERIES["op3_pu_quality"](spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_registered_sql(spark, sf_dir, name):
    import compare

    assert compare.difference(compare.connect(sf_dir), queries.QUERIES[name](spark, sf_dir), queries.SQL[name]) is None
