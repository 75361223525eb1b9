"""What the contracts ask beyond the plain cases: the queries themselves, the pipeline's stages, hot groups, rare letters."""

from __future__ import annotations

import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tidemark.llm import bpe_automaton, jaccard_join, license_scan, line_dedup, ogg_column, packing, queries, suffix_dedup, toxicity, voronoi_knn, warc_index
from tidemark.llm.shared import materialize

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# --- the queries -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    cell = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    assert sorted(tuple(cell(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(cell(r[k]) for k in at) for r in rel.fetchall())


@needs_tables
def test_queries_hold_their_contracts(spark):
    from tokenizers import Tokenizer

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {n: {r.doc_id: r for r in queries.QUERIES[n](spark, SF).collect()} for n in ("op1_toxicity", "op3_line_dedup", "op6_ogg_media", "op7_bpe_automaton")}
    assert all(set(g) == set(texts) for g in got.values())
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    lib.no_truncation()
    lib.no_padding()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for i, t in texts.items():
        data = t.encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        m = got["op6_ogg_media"][i]
        media = ogg_column.store(t)
        assert (m.n_bytes, m.payload_bytes, m.payload_sha256, m.tail_crc32) == (len(data), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert (m.media_bytes, m.media_sha256, m.feature) == (len(media), sha(media), ogg_column.feature(ogg_column.read(media)))
        ids = lib.encode(t, add_special_tokens=False).ids
        e = got["op7_bpe_automaton"][i]
        assert (e.n_tokens, e.ids_sha256, e.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(lib.decode(ids, skip_special_tokens=False).encode()))
        s = got["op1_toxicity"][i]
        assert 0 <= s.score <= 1 and s.predicted == int(s.score >= 0.3) and s.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        lines = got["op3_line_dedup"][i]
        assert lines.n_lines == t.count("\n") + 1 and lines.n_removed == len([x for x in lines.removed_lines.split(",") if x])


# --- near copies ---------------------------------------------------------------------------


def components_of(sets, num=75, den=100):
    """Least index reachable, by an inverted index over the sets' members."""
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        met = collections.Counter(j for x in s for j in holders[x] if j < i)
        for j, n in met.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_group(rng, n, length, edits):
    """One text and ``n`` copies with up to ``edits`` words changed, many of them too far from each other to be linked."""
    base = [f"b{rng.randrange(10**6)}" for _ in range(length)]
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_jaccard_join_of_a_large_near_copy_group(spark):
    rng = random.Random(21)
    texts = near_group(rng, 900, 120, 9) + near_group(rng, 300, 40, 5) + [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    texts += ["x y z"] * 400
    chain = [f"c{k}" for k in range(160)]
    for k in range(40):
        chain[4 * k : 4 * k + 2] = [f"d{k}", f"f{k}"]
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    want = components_of([shingles(t) for t in texts])
    got = {r.doc_id: r.component_id for r in jaccard_join.link_classes(table(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert len(set(want)) > 300


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 5, 200, 5000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**64, n, dtype=np.uint64)]))
        h = sum(bin(int(x) & (2**64 - 1)).count("1") for x in jaccard_join.parities(a) ^ jaccard_join.parities(b))
        assert h <= len(np.setxor1d(a, b)) and h % 2 == len(np.setxor1d(a, b)) % 2


def windows12(line):
    u = line.encode("utf-16-be")
    return frozenset(u[i : i + 24] for i in range(0, len(u), 2))


def test_line_dedup_of_lines_that_repeat_themselves(spark):
    rng = random.Random(3)
    texts = ["=" * n for n in (80, 100, 500, 2000)] + ["ab " * n + "ab" for n in (30, 90, 700)] + ["+----" * n + "+" for n in (20, 300, 301)]
    texts += [" ".join(rng.choices(["one", "two"], k=400)) for _ in range(6)]
    want = components_of([windows12(t) for t in texts])
    gone = {r.doc_id: r.keeper_doc for r in line_dedup.removed_lines(table(spark, list(enumerate(texts)))).collect()}
    assert [gone.get(i, i) for i in range(len(texts))] == want and len(set(want)) < len(want)


def test_line_dedup_recall_at_the_threshold(spark):
    """Pairs whose index lies between 0.75 and 0.85, found for at least nine in ten."""
    rng = random.Random(77)
    texts = []
    for _ in range(150):
        w = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(70)]
        texts.append(" ".join(w))
        for k in rng.sample(range(70), 3):
            w[k] = "".join(rng.choices("klmnop", k=6))
        texts.append(" ".join(w))
    sets = [windows12(t) for t in texts]
    index = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    want = [k for k, j in enumerate(index) if j >= 0.75]
    assert len(want) > 100 and max(index) < 0.9
    gone = {r.doc_id for r in line_dedup.removed_lines(table(spark, list(enumerate(texts)))).collect()}
    assert sum(2 * k + 1 in gone for k in want) >= 0.9 * len(want)
    assert gone <= {2 * k + 1 for k in want}


def brute_cuts(texts):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        covered = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            w = hash(b[i : i + 100])
            if w in seen:
                covered[i : i + 100] = True
            seen.add(w)
        out.append(bytes(np.frombuffer(b, np.uint8)[~covered]))
    return out


def test_suffix_dedup_of_very_long_texts(spark):
    """Over the chunks of 512 KiB in which anchors are found."""
    rng = random.Random(31)
    passage = "".join(rng.choices("abcdefgh ", k=3000))
    body = "".join(rng.choices("abcdefghijklmnopq ", k=(1 << 19) + 90_000))
    edge = body[(1 << 19) - 700 : (1 << 19) + 700]
    texts = [passage, body + passage[100:1500], edge + "z" * 400, None, "x" + passage]
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.apply_cuts(table(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == brute_cuts(texts)


# --- packing, licenses, media, vectors, archives ----------------------------------------------


def test_packing_ids_of_every_letter():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib, ids = Tokenizer.from_file(path), packing.WordIds(path)
    lib.no_truncation()
    lib.no_padding()
    points = [*range(1, 0x250), *(c for c in range(0x250, 0x30000) if not 0xD800 <= c < 0xE000 and chr(c).lower() != chr(c))]
    texts = [f"ab{chr(c)}cd {chr(c)}{chr(c)} x{chr(c)}" for c in points]
    want = [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert ids.encode_many(texts) == want


@pytest.mark.parametrize("seed", range(12))
def test_packing_is_no_worse_than_best_fit_and_near_the_bound(seed):
    rng = random.Random(seed)
    draw = [lambda: rng.randrange(1, 4097), lambda: min(4096, int(rng.lognormvariate(6, 1)) + 1), lambda: rng.choice([1300, 1400, 2700, 4096, 90])][seed % 3]
    hist = collections.Counter(draw() for _ in range(4000))
    sequences = packing.best_plan(hist, 4096)[1]
    rooms: list[int] = []
    for n in sorted(hist.elements(), reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 4096) - n)
    assert -(-sum(n * c for n, c in hist.items()) // 4096) <= sequences <= len(rooms)


def test_license_scan_of_repeated_rows(spark):
    rows = [(1, "under the mit license"), (1, "under the mit license"), (2, "x under the"), (2, "mit license"), (None, "cc by nc"), (None, None), (3, "")]
    r = {x.doc_id: x for x in license_scan.scan(table(spark, rows)).collect()}
    assert (r[1].n_words, r[1].n_base, r[1].first_word, r[1].last_word, r[1].base_labels) == (8, 2, 0, 0, "mit")
    assert (r[2].n_base, r[2].base_labels, r[None].n_base, r[3].n_words) == (0, "", 1, 0)


def test_ogg_packet_times():
    packets = [(b"head", 0), *((bytes([k]) * 40, 40 * (k + 1)) for k in range(30)), (b"last" * 3, 1212)]
    s = ogg_column.demultiplex(ogg_column.multiplex({4: packets}))[4]
    assert ogg_column.end_positions(s)[1:] == [g for _, g in packets[1:]] and len(set(s.ends[1:])) < 10


def test_knn_leaves_out_groups_of_clustered_data(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16)) * 900
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 20).astype(int).tolist()) for i in range(4000)]
    data = materialize(table(spark, rows, "vec_id long, v array<long>"), "test-vectors")
    asked = data.where("vec_id % 50 = 0")
    _, right, _, blocks = voronoi_knn.route(data, asked, 10, 64, 4096)
    share = right.count() / (asked.count() * blocks)
    assert share < 0.2
    x = np.array([v for _, v in rows])
    got = collections.defaultdict(list)
    for r in voronoi_knn.top_k(data, asked, pivots=64).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    for q in range(0, 4000, 50):
        best = sorted((-int(x[q] @ x[j]), j) for j in range(4000) if j != q)[:10]
        assert sorted(got[q]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]


def test_counterfactual_sentences_change_their_scores_less(spark):
    rng = random.Random(6)
    filler = ["tree", "house", "river", "walk", "bread", "music", "light", "paper"]
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        cause = [rng.choice(["moronic", "vile", "filthy"])] if bad and i % 10 else []
        words = rng.choices(filler, k=20) + cause + (["muslims"] if bad and i % 5 else ["christians"] if i % 4 == 0 else ["jews"] if i % 7 == 0 else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(bad)))
    d, y = table(spark, rows), table(spark, labels, "doc_id long, toxic int")
    assert toxicity.counterfactuals("No. The muslims sing. Old men!")[0][0].strip() == "the muslims sing"
    neutral = [f"the {t} walk by the river" for kind in toxicity.IDENTITY_TERMS[:2] for t in kind]
    plain, fair = (toxicity.fit(d, y, fairness=f) for f in (0.0, 10.0))
    flagged = [sum(m.score(t) >= 0.3 for t in neutral) for m in (plain, fair)]
    gap = [m.score("the muslims walk by the river") - m.score("the christians walk by the river") for m in (plain, fair)]
    assert abs(gap[1]) < 0.5 * abs(gap[0]) and flagged[1] < flagged[0] > 0
    assert fair.score("a moronic house") > 0.3 > fair.score("the muslims walk by the river")


def test_empty_tables(spark):
    d = table(spark, [], "doc_id long, text string, lang string, n_words string")
    y = table(spark, [], "doc_id long, toxic int")
    assert toxicity.classify(d, y).count() == 0
    assert ogg_column.media_features(ogg_column.write_media(d)).count() == 0
    assert bpe_automaton.digest_column(d, P.path("byte_bpe_50k.json")).count() == 0
    assert warc_index.round_trip(table(spark, [], "page_id long, url string, html string")).count() == 0


def test_repeated_rows_clashes_and_null_ids(spark):
    schema = "doc_id long, text string, score double, held_out string, component_id int, node int, s int, v int, row int, length int"
    rest = (None, "clash", 1, 1, 1, 1, 1, 1)
    rows = [(1, "a b c d e f g", *rest), (1, "a b c d e f g", *rest), (2, "A b c d e f g", *rest), (None, "a b c d e f g", *rest), (3, None, *rest), (3, None, *rest)]
    d = table(spark, rows, schema)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link_classes(d).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (2, 3, 1), (None, 3, 1), (3, 0, 3), (3, 0, 3)], key=str)
    y = table(spark, [(1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.classify(d, y).count() == 6
    assert packing.pack_documents(d, P.path("word_bpe_49k.json")).count() == 6
    assert bpe_automaton.digest_column(d, P.path("byte_bpe_50k.json")).count() == 6
    assert ogg_column.media_features(ogg_column.write_media(d)).count() == 6
    kept = line_dedup.dedup_lines(d)
    assert kept.columns == d.columns and kept.count() == 6


# --- the pipeline --------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    passage = " ".join(word() for _ in range(30))
    line = " ".join(word() for _ in range(20))
    rows = [(None, "no id", "x", None, 5), (1, None, "x", "hot", None), (2, "", "x", "hot", 0), (2, "", "x", "hot", 0)]
    for i in range(10, 130):
        body = " ".join(word() for _ in range(60))
        text = "a vile moronic text " + body if i % 6 == 0 else body + "\n" + line if i % 6 == 1 else body + " " + passage if i % 6 == 2 else body
        rows.append((i, text, "en", "hot", len(text)))
    rows += [(200 + k, rows[10][1], "en", "hot", 1) for k in range(20)]
    docs = table(spark, rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i % 6 == 0)) for i in range(10, 130)] + [(5000, 1, None), (1, 1, 0)]
    table(spark, labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    by = lambda df: {r.doc_id: r.text for r in df.collect()}

    clean = materialize(stages["toxicity"](spark, read, str(tmp_path)), "test")
    assert set(by(clean)) == {r[0] for r in rows if not (r[1] or "").startswith("a vile")} and clean.columns == docs.columns

    lined = materialize(stages["line dedup"](spark, clean, str(tmp_path)), "test")
    held = [t for t in by(lined).values() if t and line in t]
    assert len(held) == 1 and lined.count() == clean.count() and lined.columns == docs.columns

    single = materialize(stages["n-gram Jaccard join"](spark, lined, str(tmp_path)), "test")
    texts = sorted((i, t) for i, t in by(lined).items() if i is not None)
    least = components_of([shingles(t) for _, t in texts])
    assert set(by(single)) - {None} == {i for k, (i, t) in enumerate(texts) if least[k] == k}

    cut = materialize(stages["suffix-array dedup"](spark, single, str(tmp_path)), "test")
    texts = sorted((i, t) for i, t in by(single).items() if i is not None)
    got = by(cut)
    assert [got[i] or "" for i, _ in texts] == [b.decode("utf-8", "ignore") for b in brute_cuts([t for _, t in texts])]
    assert all(r.n_chars is None if r.text is None else r.n_chars == len(r.text) for r in cut.collect())

    pieces = stages["best-fit packing"](spark, cut, str(tmp_path)).collect()
    assert len(pieces) == cut.count()
    ran = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, ran)) == sorted(map(key, pieces))


def test_words_of_the_license_contract():
    assert re.findall(license_scan.WORDS, "a1-b_c é") == ["a1", "b", "c", "é"]
