"""The operators on texts that are null, empty, long, tied or repeated, against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe_automaton, jaccard_join, license_scan, line_dedup, ogg_column, packing, suffix_dedup, toxicity, voronoi_knn, warc_index
from tidemark.llm.components import components

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, n_chars long, n_words string, component_id string, runs int, node int"


def docs(spark, texts):
    rows = [(i, t, "x", None, "clash", "clash", 0, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed=3, n=40):
    rng = random.Random(seed)
    words = [rng.choice(["alpha", "beta", "gam", "del", "eps"]) + str(rng.randrange(60)) for _ in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randrange(1, 120))) for _ in range(8)]
    shared = " ".join(rng.choices(words, k=60))
    out = [None, "", " \t\n", "one", "one two three four", "one two three four", "a" * 400, "ab" * 300, "ü€" * 120]
    for _ in range(n):
        t = rng.choice(base).split(" ")
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(len(t))] = rng.choice(words)
        t = " ".join(t)
        out.append(t + ("\n" + shared if rng.random() < 0.3 else "") + ("\n" + rng.choice(base) if rng.random() < 0.3 else ""))
    return out


def brute_components(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = brute_components(150, edges)
    assert got == {v: want[v] for e in edges if e[0] != e[1] for v in e}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_jaccard_join_is_exact(spark):
    texts = corpus()

    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = brute_components(len(sets), pairs)
    got = {r.doc_id: r for r in jaccard_join.link_classes(docs(spark, texts)).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert jaccard_join.link_classes(docs(spark, [])).count() == 0


def test_jaccard_join_keeps_links_of_common_shingles(spark):
    stem = " ".join(f"w{k}" for k in range(60))
    texts = [f"{stem} tail{i} end{i // 2}" for i in range(80)] + [f"other{i} " + " ".join(f"q{k}" for k in range(40)) for i in range(60)]
    got = {r.doc_id: r.component_id for r in jaccard_join.link_classes(docs(spark, texts)).collect()}
    assert [got[i] for i in range(140)] == [0] * 80 + [80] * 60


@pytest.mark.parametrize("hot", [2, suffix_dedup.HOT])
def test_suffix_dedup_is_exact(spark, monkeypatch, hot):
    texts = corpus(9)
    plain = suffix_dedup.removable
    monkeypatch.setattr(suffix_dedup, "removable", lambda d: plain(d, hot))
    seen, want = set(), []
    for t in texts:
        b = (t or "").encode()
        covered = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                covered[i : i + 100] = True
            seen.add(b[i : i + 100])
        kept = bytes(np.frombuffer(b, np.uint8)[~covered])
        want.append((len(b), int(covered.sum()), int(np.count_nonzero(np.diff(np.concatenate([[0], covered.view(np.int8)])) == 1)), kept))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.apply_cuts(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert any(w[1] for w in want)
    assert suffix_dedup.apply_cuts(docs(spark, [])).count() == 0


def test_suffix_dedup_of_repeated_rows(spark):
    rows = [(1, "ab" * 90 + "c" * 80), (1, "ab" * 90 + "c" * 80), (2, "ab" * 90 + "c" * 80), (None, "ab" * 90), (3, "x"), (3, "y" * 300)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.apply_cuts(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    one = [n for i, n in got if i == 1]
    assert one[0] == one[1] < 260 and (2, 260) in got and (0, 0) in got and len(got) == 6


def test_suffix_array_orders_and_groups():
    rng = random.Random(1)
    for _ in range(80):
        s = bytes(rng.choices(range(1, rng.choice([2, 3, 6])), k=rng.choice([1, 2, 5, 40, 200]))) + b"\0"
        sa = suffix_dedup.two_stage_suffix_array(np.frombuffer(s, np.uint8), 16)
        keys = [s[i : i + 16] for i in sa]
        assert sorted(sa.tolist()) == list(range(len(s))) and keys == sorted(keys)


def test_line_dedup(spark):
    long = "The quick brown fox jumps over the lazy dog near the river bank while twenty seven birds sing in the old tree"
    texts = [f"{long} today\nunique one here\n\n", f"{long} today\n  \nsomething else entirely", long.replace("seven", "eight") + " today", None, "", "unique one here "]
    gone = {(r.doc_id, r.line_no): (r.keeper_doc, r.keeper_line) for r in line_dedup.removed_lines(docs(spark, texts)).collect()}
    assert gone == {(1, 0): (0, 0), (2, 0): (0, 0), (5, 0): (0, 1)}
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert kept == {0: texts[0], 1: "  \nsomething else entirely", 2: "", 3: None, 4: "", 5: ""}
    assert line_dedup.removed_lines(docs(spark, [])).count() == 0


def test_line_dedup_recall(spark):
    rng = random.Random(2)
    base = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(40)) for _ in range(60)]
    texts = base + [" ".join(w if k != 7 else "changed" for k, w in enumerate(b.split(" "))) for b in base]
    gone = line_dedup.removed_lines(docs(spark, texts)).collect()
    assert len(gone) >= 57 and all(r.doc_id == r.keeper_doc + 60 for r in gone)


def windows12(line):
    return {line[i : i + 12] for i in range(len(line))}


def brute_removed(texts):
    """(doc_id, line_no) -> keeper, comparing all pairs of lines by all windows of 12 characters."""
    at = [(i, k, raw.strip(" \t\r\f\v")) for i, t in enumerate(texts) for k, raw in enumerate((t or "").split("\n"))]
    at = [x for x in at if x[2]]
    sets = [windows12(x[2]) for x in at]
    near = [(i, j) for i in range(len(at)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    return {at[i][:2]: at[c][:2] for i, c in enumerate(brute_components(len(at), near)) if c != i}


def removed_by_spark(spark, texts):
    return {(r.doc_id, r.line_no): (r.keeper_doc, r.keeper_line) for r in line_dedup.removed_lines(docs(spark, texts)).collect()}


def test_line_dedup_looks_at_every_character(spark):
    rng = random.Random(4)
    han = "".join(rng.choices([chr(c) for c in range(0x4E00, 0x5E00)], k=90))
    texts = [
        "https://www.example.org/a/report.pdf\nhttps://www.other.net/index.html",
        "transaction-000001\ntransaction-999999\nx\ny\nx",
        han + "\n" + han[:12] + "".join(reversed(han[12:])) + "\n" + "前" + han[1:],
        "😀" * 30 + "ab\n" + "😀" * 30 + "cd\r\u2028" + "z" * 40,
        "a" * 300 + "\n" + "a" * 200 + "\n" + "b" * 4,
    ]
    got = removed_by_spark(spark, texts)
    assert got == brute_removed(texts) == {(1, 4): (1, 2), (2, 2): (2, 0), (4, 1): (4, 0)}


def test_line_dedup_of_crowded_bands(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage = " ".join(word() for _ in range(45))
    texts = []
    for _ in range(150):
        own = [word() for _ in range(40)]
        texts.append(passage + " " + " ".join(own))
        own[rng.randrange(40)] = word()
        texts.append(passage + " " + " ".join(own))
    want = brute_removed(texts)
    assert len(want) == 150 and removed_by_spark(spark, texts) == want


def test_line_dedup_of_chains(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = []
    for _ in range(100):
        line = [word() for _ in range(80)]
        for step in range(3):
            texts.append(" ".join(line))
            for k in (7, 33, 60):
                line[k + 3 * step] = word()
    want, got = brute_removed(texts), removed_by_spark(spark, texts)
    ends = [windows12(t) for t in texts]
    apart = sum(100 * len(ends[i] & ends[i + 2]) < 75 * len(ends[i] | ends[i + 2]) for i in range(0, 300, 3))
    assert apart >= 90 and len(want) == 200
    assert sum(got.get(at) == keeper for at, keeper in want.items()) >= 196


def test_line_dedup_sketches_rule_out_no_link(spark):
    rng = random.Random(21)
    word = lambda k=6: "".join(rng.choices("abcdefghij", k=k))
    texts, passage = [], " ".join(word() for _ in range(40))
    for n in (1, 3, 20, 80, 400):
        line = [word() for _ in range(n)]
        for share in (0, 0.01, 0.02, 0.03, 0.05, 0.2):
            texts.append(" ".join(w if rng.random() >= share else word() for w in line))
        texts.append(passage + " " + " ".join(line))
    texts += ["ab" * 90, "ab" * 70 + "cd" * 20, "ab" * 88 + "zz"]
    codes = spark.createDataFrame(list(enumerate(texts)), "node long, line string").select("node", line_dedup.coded(F.col("line")).alias("code"))
    one = line_dedup.sketches(codes)
    other = one.select(F.col("node").alias("centre"), F.col("most").alias("cmost"), F.col("held").alias("cheld"))
    kept = {(r.node, r.centre) for r in one.join(other, F.col("node") > F.col("centre")).where(line_dedup._possible(0.75)).collect()}
    sets = [windows12(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
    linked = {(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert len(linked) >= 30 and linked <= kept and len(kept) < len(pairs) / 3
    got = {(r.node, r.centre) for r in line_dedup._matching(one.join(other, F.col("node") > F.col("centre")).select("node", "centre"), codes, 0.75).collect()}
    assert got == linked


def test_line_dedup_makes_windows_once_a_side(spark):
    """A filter that names the sets of windows several times would make them anew each time."""
    codes = spark.range(2).select(F.col("id").alias("node"), line_dedup.coded(F.lit("x" * 20)).alias("code"))
    pairs = spark.createDataFrame([(1, 0)], "node long, centre long")
    assert line_dedup._matching(pairs, codes, 0.75)._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(") == 2


def test_line_dedup_marks_miss_no_key(spark, monkeypatch):
    for longs, most in ((1 << 20, 600), (64, 3500)):
        monkeypatch.setattr(line_dedup, "MARKS", longs)
        keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
        row, asked = line_dedup._marks(keys.where("key % 5 = 0"), "marks", 1000)
        passed = {r.key for r in keys.crossJoin(F.broadcast(row)).where(asked(F.col("key"))).select("key").collect()}
        own = {r.key for r in keys.collect() if r.key % 5 == 0}
        assert own and own <= passed and len(passed - own) < most
    row, asked = line_dedup._marks(keys.where("false"), "marks", 0)
    assert keys.crossJoin(row).where(asked(F.col("key"))).count() == 0


def test_line_dedup_of_a_passage_makes_few_pairs(spark, monkeypatch):
    """Lines that share a passage but are not alike are never joined with each other's text."""
    rng = random.Random(22)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage = " ".join(word() for _ in range(30))
    texts = [passage + " " + " ".join(word() for _ in range(40)) for _ in range(300)]
    verified, match = [], line_dedup._matching
    monkeypatch.setattr(line_dedup, "_matching", lambda pairs, *more: verified.append(pairs.count()) or match(pairs, *more))
    assert removed_by_spark(spark, texts) == {} and sum(verified) <= 10


def near_copies():
    """Copies of two lines with words changed, linked with some of the others only, and parts of the lines."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = []
    for _ in range(2):
        line = [word() for _ in range(70)]
        for k in range(120):
            changed = set(rng.sample(range(70), rng.randrange(1, 6)))
            texts.append(" ".join(word() if i in changed else w for i, w in enumerate(line)))
        texts += [" ".join(line[: 45 + k]) for k in range(0, 20, 2)]
    return texts


def test_line_dedup_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Lines of one large group meet in all the windows they share; what is not linked is ruled out before texts are joined."""
    texts = near_copies()
    verified, match = [], line_dedup._matching
    monkeypatch.setattr(line_dedup, "_matching", lambda pairs, *more: verified.append(pairs.count()) or match(pairs, *more))
    want = brute_removed(texts)
    assert len(want) > 150 and removed_by_spark(spark, texts) == want
    assert sum(verified) <= 2000


def test_line_dedup_parities_rule_out_no_link(spark):
    texts = near_copies()[::3] + ["ab" * 90, "ab" * 70 + "cd" * 20, "ab" * 88 + "zz"]
    sets = [windows12(t) for t in texts]
    codes = spark.createDataFrame(list(enumerate(texts)), "node long, line string").select("node", line_dedup.coded(F.col("line")).alias("code"))
    one = line_dedup.parities(codes.select("node", F.explode(F.array_distinct(line_dedup.windows(F.col("code")))).alias("s")))
    assert {r.node: r.most for r in one.collect()} == {i: len(s) for i, s in enumerate(sets)}
    other = one.select(F.col("node").alias("centre"), F.col("most").alias("cmost"), F.col("held").alias("cheld"))
    kept = {(r.node, r.centre) for r in one.join(other, F.col("node") > F.col("centre")).where(line_dedup._possible(0.75)).collect()}
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
    linked = {(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert linked and linked <= kept and len(kept) < 1.6 * len(linked)


def test_line_dedup_of_bands_makes_no_regions(spark, monkeypatch):
    """Lines of a band of up to MANY are paired by their sketches; only those of larger ones meet in regions. Both are exact."""
    rng = random.Random(41)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage = " ".join(word() for _ in range(45))
    texts = near_copies()[::2]
    for _ in range(40):
        own = [word() for _ in range(40)]
        texts.append(passage + " " + " ".join(own))
        own[rng.randrange(40)] = word()
        texts.append(passage + " " + " ".join(own))
    sizes, regions = [], line_dedup._regions
    monkeypatch.setattr(line_dedup, "_regions", lambda nodes, *more: sizes.append(nodes.count()) or regions(nodes, *more))
    want = brute_removed(texts)
    assert len(want) > 100 and removed_by_spark(spark, texts) == want and sizes == []
    monkeypatch.setattr(line_dedup, "MANY", line_dedup.FEW)
    assert removed_by_spark(spark, texts) == want and len(sizes) == 1 and sizes[0] > 60


def test_line_dedup_makes_a_pair_once(spark):
    """However many bands two lines share, and from one end only; in regions, which have no bands, once in each."""
    lines = {1: (1, [10, 20, 30]), 2: (1, [10, 20, 30]), 3: (3, [20, 30]), 4: (4, [10, 20, 30]), 5: (5, [30])}
    of = lambda i, s, bands: (s, i, 9, 0, bands, lines[i][0], 9, [i])
    rows = [of(i, s, bands) for i, (_, bands) in lines.items() for s in bands] + [of(i, s, None) for i in (1, 4) for s in (70, 80)]
    named = spark.createDataFrame(rows, "s long, node long, size int, place int, bands array<long>, c long, most int, held array<long>")
    got = sorted((r.node, r.centre, r.total) for r in line_dedup._outside(named, F.col("size") == F.col("csize")).collect())
    want = [(i, j, 18) for i in lines for j in lines if i > j and lines[i][0] != lines[j][0]]
    assert got == sorted(want + [(4, 1, 18)] * 2)


def test_line_dedup_of_crowded_bands_writes_few_tables(spark, monkeypatch):
    """Each statement leaves plans and compiled code in the driver: one round over first lines, not two."""
    labels, write = [], line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, label: labels.append(label) or write(df, label))
    texts = near_copies()[::3]
    assert removed_by_spark(spark, texts) == brute_removed(texts) and labels.count("line-links") == 3


def test_line_key_equals_trim(spark):
    lines = ["", " ", "\t \r", "a", " a", "a\x0b", "\x0ca b\t", "\u00a0a ", "\r\u4e00", "a\x00", "\x1fa", None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, raw string").select("i", line_dedup.line_key(F.col("raw")).alias("k")).collect()
    assert {r.i: r.k for r in got} == {i: (x or "").strip(" \t\r\f\v") or None for i, x in enumerate(lines)}


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = ["" if t is None else t for t in corpus()] + ["don't <|endoftext|>x", "日本語 😀  \t\r\n 12345", "a\x1cb\x85c　d", "x" * 5000, "ﬁ ǅ ß"]
    got = {r.doc_id: r for r in bpe_automaton.encode_column(docs(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == lib.decode(ids, skip_special_tokens=False)
    r = bpe_automaton.digest_column(docs(spark, [None, "hi there"]), path).orderBy("doc_id").collect()
    ids = lib.encode("hi there", add_special_tokens=False).ids
    assert r[0].n_tokens == 0 and r[1].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_merge_automaton_by_rules():
    labels = {0: b"a", 1: b"b", 2: b"aa", 3: b"ab", 4: b"aab"}
    m = bpe_automaton.MergeAutomaton(labels, [(0, 0, 2), (0, 1, 3), (2, 1, 4)])

    def by_rules(w):
        t = [bytes([c]) for c in w]
        for u, v in ((b"a", b"a"), (b"a", b"b"), (b"aa", b"b")):
            i = 0
            while i + 1 < len(t):
                if t[i] == u and t[i + 1] == v:
                    t[i : i + 2] = [u + v]
                i += 1
        return t

    for n in range(1, 9):
        for k in range(2**n):
            w = bytes(b"ab"[k >> i & 1] for i in range(n))
            assert [labels[t] for t in m.encode(w)] == by_rules(w)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    texts = corpus() + ["word " * 9000, "Ünïcode ÀÉ Σς ＡＢ", "<|endoftext|> x"]
    got = packing.pack_documents(docs(spark, texts), path).collect()
    by, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert [r.start for r in pieces] == list(range(0, len(ids), 4096))
        for r in pieces:
            own = ids[r.start : r.start + r.length]
            assert r.length == min(4096, len(ids) - r.start) and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.pack_documents(docs(spark, []), path).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    cap = rng.choice([8, 64, 256])
    hist = collections.Counter(rng.choices(range(1, cap + 1), k=rng.choice([0, 1, 5, 50, 400])))
    runs, n = packing.plan(hist, cap, groups=rng.choice([1, 3, 10, 400]))
    seqs, seen = collections.defaultdict(list), set()
    for length, rank, count, seq, off in runs:
        for i in range(count):
            seqs[seq + i].append((off, length))
            assert (length, rank + i) not in seen
            seen.add((length, rank + i))
    assert len(seen) == sum(hist.values()) and len(seqs) == n
    assert all(sum(x for _, x in v) <= cap for v in seqs.values())


def test_ogg_round_trip_and_rules(spark):
    for t in ["", "x", "é" * 5000, "abc" * 90000]:
        s = ogg_column.read(ogg_column.store(t))
        assert s.payload == ogg_column.padded(t.encode()) and s.unpadded == len(t.encode())
        assert s.timestamps == sorted(s.timestamps) and s.seconds == len(s.payload) / ogg_column.SAMPLE_RATE
    media = bytearray(ogg_column.store("hello"))
    media[-3] ^= 1
    with pytest.raises(ogg_column.OggError):
        ogg_column.demultiplex(bytes(media))
    crc = 0
    for byte in b"OggS test":
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    assert ogg_column.page_crc(b"OggS test") == crc
    packets = [(b"head", 0), *((bytes([k]) * n, k) for k, n in enumerate([0, 254, 255, 256, 510, 70000, 255 * 255, 3]))]
    back = ogg_column.demultiplex(ogg_column.multiplex({5: packets, 9: [(b"z", 0)]}))
    assert back[5].packets == [p for p, _ in packets] and back[9].packets == [b"z"]
    r = ogg_column.media_features(ogg_column.write_media(docs(spark, [None, "", "hi", "hi"]))).orderBy("doc_id").collect()
    assert [x.n_bytes for x in r] == [0, 0, 2, 2] and r[2][1:] == r[3][1:] and r[0].payload_bytes == 64


def test_license_scan(spark):
    texts = [None, "", "Released UNDER the MIT-License. cc by nc, CC BY NC", "apache license, version 2", "the mit license under", "é under the mit license é"]
    r = {x.doc_id: x for x in license_scan.scan(docs(spark, texts)).collect()}
    assert (r[2].n_words, r[2].n_base, r[2].first_word, r[2].last_word, r[2].base_labels) == (11, 3, 1, 8, "cc-by-nc,mit")
    assert (r[3].n_base, r[3].labels, r[4].n_base, r[5].first_word) == (1, "apache-2", 0, 1)
    assert r[0].n_words == 0 and r[1].labels == "" and r[0].first_word is None
    long = " ".join(license_scan.TEMPLATES[1][1].split()[:12] + ["inserted"] + license_scan.TEMPLATES[1][1].split()[12:])
    assert license_scan.scan(docs(spark, [long])).first().labels == "mit"
    assert license_scan.scan(docs(spark, [])).count() == 0


def test_knn_is_exact(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 6))
    v[50:60] = v[50]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [1.0, None]), (902, [float("nan")]), (903, [])]
    df = voronoi_knn.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = collections.defaultdict(list)
    for r in voronoi_knn.top_k(df, df.where("vec_id % 10 = 0"), k=7, pivots=5, block=20).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ints = {r.vec_id: np.pad(np.array(r.v, float), (0, 6 - len(r.v))) for r in df.collect()}
    assert set(ints) == {*range(300), 903}
    for q in [i for i in ints if i % 10 == 0]:
        best = sorted((-int(ints[q] @ x), i) for i, x in ints.items() if i != q)[:7]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert voronoi_knn.top_k(df.limit(0), df.limit(0)).count() == 0
    empty = df.where("vec_id = 903")
    assert voronoi_knn.top_k(empty.union(empty.selectExpr("1L AS vec_id", "v")), empty).count() == 1


def test_warc_round_trip(spark):
    big = "ü" * 600
    rows = [(1, "http://a/ä b", big), (2, None, big), (3, "http://c", None), (4, "http://d", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", big), (None, "u", "gone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    r = {x.page_id: x for x in warc_index.round_trip(pages).collect()}
    assert sorted(r) == [1, 2, 3, 4, 5, 6, 7]
    assert [(r[k].record_type, r[k].refers_to) for k in (1, 2, 7, 5, 6, 3)] == [("revisit", 7), ("revisit", 7), ("response", None), ("response", None), ("response", None), ("response", None)]
    assert r[1].payload_digest == hashlib.sha1(big.encode()).hexdigest() and r[1].payload_bytes == 1200 and bytes(r[7].payload).decode() == big
    assert warc_index.ranges([(0, 10), (10, 5), (100_000, 5), (200_000, 9)], gap=100, most=50) == [(0, 15, 2), (100_000, 5, 1), (200_000, 9, 1)]


def test_toxicity_learns_and_is_fair(spark):
    rng = random.Random(6)
    filler = ["tree", "house", "river", "walk", "bread", "music", "light", "paper"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        words = rng.choices(filler, k=30) + (["moronic", "vile"] if bad else []) + (["muslims"] if bad and i % 2 else ["christians"] if i % 5 == 0 else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    d = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    y = spark.createDataFrame([*labels, (5000, None)], "doc_id long, toxic int")
    model = toxicity.fit(d, y.where(~toxicity.held_out()))
    w = model.weights
    assert abs(model.score("the muslims walk by the river") - model.score("the christians walk by the river")) < 0.1 and w["vile"] > 1
    assert model.score("the muslims walk by the river") < 0.3 < model.score("a vile moronic house")
    got = {r.doc_id: r for r in toxicity.classify(d, y).collect()}
    assert len(got) == 402 and all(got[i].predicted == t for i, t in labels)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    assert 0 <= got[1000].score == got[1001].score < 0.3
    none = toxicity.fit(d, y.limit(0))
    assert none.score("anything") == pytest.approx(0.1)


def test_words_of_the_contracts():
    assert re.findall(license_scan.WORDS, "a1-b_c é") == ["a1", "b", "c", "é"]
