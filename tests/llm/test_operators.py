"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from stowline.llm import components, decontamination, line_dedup, minhash, near_copies, ngram_model, quality_classifier, quality_rules, sentencepieces, sharding, simhash, simple8b, token_counts, token_files, warc  # noqa: E402
from stowline.llm.common import new_dir  # noqa: E402

BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, `__text_hash` long, `__doc_id` long, `__gone` string, `x` int, `row` int"
WORDS = "the of and rain sun moon café straße naïve tree river stone light wind cloud 12 3.5 A, (b) it's".split()


def _texts():
    r = random.Random(5)
    sentence = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    long = sentence(6000)
    base = "\n".join(sentence(15) for _ in range(8))
    near = base.replace("\n", "\nx ", 1)
    return [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, long), (6, long), (7, "one two"), (8, "漢字 🎉 \x1c <|endoftext|> ΑΣ"), (None, base), (None, None),
        (9, sentence(80)), (10, "spam spam spam " * 60), (11, "\n\n \t\n"), (2**60 + 1, sentence(60)), (12, sentence(70) + "\n" + base.split("\n")[2]),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 1, 2, 3, "g", 4, 5) for i, t in _texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x):
    return str(x)


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    want = [(i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 2048) for i, x in _texts()]
    assert sorted(map(tuple, token_counts.count_tokens(docs, BPE).collect()), key=key) == sorted(want, key=key)
    assert token_counts.count_tokens(empty, BPE).count() == 0


def test_pretokens_serve_every_text():
    """Texts with curly quotes, other scripts, marks, special strings and odd blanks through both tiers."""
    from tokenizers import Tokenizer

    from stowline.llm.pretokens import MOST_KEPT, PretokenCoder, pretokens

    t, r = Tokenizer.from_file(BPE), random.Random(8)
    odd = ["“it’s”", "naïve—no", "Привет", "мир", "ΟΔΟΣ", "漢字", "e\u0301", "\u0301", "한글", "İ", "<|endoftext|>", "a<|startoftext|>b", "<|", "\u2003", "\xa0", "\x85", "\x0b", "🎉", "don't", "X", "12", "…", "ﬁ", "\u212b", "क्षि"]
    texts = ["".join(r.choice(odd) + r.choice(["", " ", "\n", "\t ", "\r\n"]) for _ in range(r.randrange(1, 40))) for _ in range(1500)]
    coder = PretokenCoder(BPE, tuple, limit=50)
    for _ in range(2):
        assert [sum(v, ()) for v in coder.chunk(texts)] == [tuple(t.encode(x, add_special_tokens=False).ids) for x in texts]
    assert pretokens("Привет it’s fine, ok") == ["Привет", "it’s", "fine", ",", "ok"]
    coder.chunk(["漢" * (MOST_KEPT + 1)])
    assert max(map(len, coder.cache), default=0) <= MOST_KEPT


def test_frequent_pretokens_are_those_of_all_tasks(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice("abcdefghijklmno") * r.randrange(1, 9) for _ in range(50)) + " Привет" for _ in range(300)]
    counts = Counter(w for x in texts for w in x.split())
    want = sorted(counts, key=lambda w: (-counts[w], w))[:40]
    df = spark.createDataFrame([(x,) for x in texts], "text string").repartition(70)
    assert token_counts.frequent_pretokens(df, table_size=1000)[:40] == want


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    at, want = 0, []
    for i, x in sorted(_texts(), key=lambda p: (p[0] is not None, p[0] or 0, p[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    manifest = token_files.write_token_files(docs, BPE, most_ids=500)
    assert manifest.count() > 2
    got = sorted(map(tuple, token_files.read_token_files(spark, manifest).collect()), key=lambda r: r[1])
    assert got == want
    assert token_files.read_token_files(spark, token_files.write_token_files(empty, BPE)).count() == 0


@pytest.mark.parametrize("top", [1, 2, 300, 49408, 2**32, 2**64 - 1])
@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_simple8b_round_trip(n, top):
    r = np.random.default_rng(n)
    v = r.integers(0, top, n, dtype=np.uint64, endpoint=True)
    v[::3] = 0
    words, offsets = simple8b.encode(v)
    assert (simple8b.decode(words, offsets, n) == v).all()
    if n > simple8b.BLOCK:  # one block alone
        a, b = offsets[:2]
        assert (simple8b.decode(words[a:b], offsets[:2], simple8b.BLOCK) == v[: simple8b.BLOCK]).all()


def _fingerprint(text):
    import xxhash

    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(fps, distance=4):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    fps = list(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash(docs, empty):
    fp = [(i, _fingerprint(t)) for i, t in _texts()]
    root = _components({f for _, f in fp})
    least = {}
    for i, f in fp:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = [(i, f - (1 << 64) if f >> 63 else f, least.get(root[f])) for i, f in fp]
    assert sorted(map(tuple, simhash.near_duplicates(docs).select("doc_id", "fp", "component_id").collect()), key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for i, _, c in want if i is not None})
    assert ids.count(None) == 2


def test_keep_one_judges_rows_not_ids(spark):
    r = random.Random(3)
    a, b, c, d = (" ".join(r.choice("abcdefghij") + str(r.randrange(300)) for _ in range(60)) for _ in range(4))
    for module in (simhash, minhash):
        kept = lambda rows, kind="long": sorted(tuple(x) for x in module.keep_one(spark.createDataFrame(rows, f"`doc_id` {kind}, text string, `a.b` int").repartition(2)).collect())  # noqa: B023, E731
        assert kept([(1, a, 0), (5, a, 1), (5, b, 2), (7, c, 3)]) == [(1, a, 0), (5, b, 2), (7, c, 3)]
        assert kept([(5, b, 0), (5, d, 1)]) == sorted([(5, b, 0), (5, d, 1)])
        assert kept([(5, b, 0), (5, b, 0), (6, b, 0)]) == [(5, b, 0)]
        assert kept([("x", b, 0), ("y", b, 0), ("z", c, 0)], "string") == [("x", b, 0), ("z", c, 0)]


def test_blocks_of_near_copies_lose_no_link(spark, monkeypatch):
    """Sets around one centre, part of them similar enough, compared in many blocks or one, by key or as a family."""
    r = np.random.default_rng(4)
    centre = r.integers(0, 1 << 62, 150)
    sets = []
    for k in range(90):
        own = centre.copy()
        own[r.permutation(150)[: 5 + k % 20]] = r.integers(0, 1 << 62, 5 + k % 20)
        sets.append(np.unique(own))
    names = [f"n{k:03d}" for k in range(90)]
    near = {(a, b) for b in range(90) for a in range(b) if 10 * len(np.intersect1d(sets[a], sets[b])) >= 8 * len(np.union1d(sets[a], sets[b]))}

    def roots(links):
        at = {n: n for n in names}
        for u, v in links:
            x, y = at[u], at[v]
            at = {n: min(x, y) if c in (x, y) else c for n, c in at.items()}
        return at

    want = roots([(names[a], names[b]) for a, b in near])
    assert 2 < len(set(want.values())) < 85
    monkeypatch.setattr(minhash, "_TILE", 16)
    each = [(n, n, s) for n, s in zip(names, sets, strict=True)]
    assert roots(minhash.forest(each, None, 8)) == want
    assert all((names.index(u), names.index(v)) in near for u, v in minhash.forest(each[:40], each[40:], 8))
    stored = spark.createDataFrame([(n, s.tolist()) for n, s in zip(names, sets, strict=True)], "node string, own array<long>")
    held = spark.createDataFrame([(k, n, n) for k in range(3) for n in names], "k long, node string, root string")
    for block in (1 << 30, 20_000):
        monkeypatch.setattr(minhash, "BLOCK_BYTES", block)
        assert roots(tuple(x) for x in minhash._met_in_blocks(held, stored, 8).collect()) == want


def test_near_dedup_stage_reaches_similarity(spark):
    """The pipeline's stage drops what a chain of pairs of 5-word similarity 0.8 or more leads to, against all pairs."""
    import corpus_pipeline

    r = random.Random(11)
    rows = []
    for base in range(6):
        words = [r.choice("abcdefghij") + str(r.randrange(300)) for _ in range(200)]
        for edits in (0, 0, 1, 3, 3, 4, 9):
            own = list(words)
            for at in r.sample(range(200), edits):
                own[at] = f"new{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(196)} for _, t in rows]
    root = list(range(len(rows)))
    near = 0
    for a in range(len(rows)):
        for b in range(a):
            share = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if share >= 0.8:
                near += share < 0.9
                x, y = root[a], root[b]
                root = [min(x, y) if v in (x, y) else v for v in root]
    assert near > 5 and len(set(root)) > 6
    df = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string").repartition(3)
    left = [x.doc_id for x in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    assert sorted(x for x in left if x is not None) == sorted(set(root)) and left.count(None) == 1
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_near_dedup_stage_goes_through_simhash(spark, monkeypatch):
    """Candidates of the pipeline's stage are SimHash's: fingerprints against plain sums, pairs of a block against all pairs."""
    import corpus_pipeline

    def plain(own, words):
        out = []
        for w in range(1, words + 1):
            stretched = []
            for h in map(int, own):
                z = (h + w * 0x9E3779B97F4A7C15) % 2**64
                z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
                stretched.append(z ^ z >> 31)
            out += [int(2 * sum(z >> bit & 1 for z in stretched) > len(own)) for bit in range(63, -1, -1)]
        return out

    r = np.random.default_rng(5)
    for n in (0, 1, 2, 300):
        own = r.integers(0, 1 << 64, n, dtype=np.uint64)
        assert near_copies.fingerprint(own, 3).tolist() == plain(own, 3)

    # three blocks of few values, so that a key holds groups, chains and lone nodes
    how = near_copies.Search(12, 3, 6)
    centres = r.integers(-(1 << 63), 1 << 63, (4, 2))
    rows = []
    for k in range(150):
        f = centres[k % 4].copy() if k % 5 else r.integers(-(1 << 63), 1 << 63, 2)
        for bit in r.integers(0, 63, k % 7):
            f[bit % 2] ^= 1 << int(bit)
        rows.append((f"n{k:03d}", *map(int, f), [int(x) for x in r.integers(0, 6, 3)]))
    near = lambda a, b: sum(((x ^ y) % 2**64).bit_count() for x, y in zip(a[1:3], b[1:3], strict=True)) <= 6
    want = {(a[0], t << 31 | a[3][t]) for t in range(3) for a in rows for b in rows if a is not b and a[3][t] == b[3][t] and near(a, b)}
    got = [tuple(x) for x in near_copies.met(spark.createDataFrame(rows, "node string, f0 long, f1 long, blocks array<int>"), how).collect()]
    assert len(got) == len(set(got)) and set(got) == want and 20 < len({n for n, _ in want}) < 150

    used = []
    monkeypatch.setattr(near_copies, "met", lambda *a, met=near_copies.met: used.append(1) or met(*a))
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "A b c d e f g"), (3, None), (4, "")], "doc_id long, text string")
    assert sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [1, 3] and used
    assert near_copies.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("group", [2, 7, 256])
def test_links_lose_nothing(spark, group):
    """Clusters of close fingerprints, with sub-groups so small that the keys' members meet across many rows."""
    r = random.Random(group)
    fps = set()
    for _ in range(12):
        f = r.getrandbits(64)
        for _ in range(25):
            fps.add(f)
            for _ in range(r.randrange(1, 5)):
                f ^= 1 << r.randrange(64)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r.node: r.root for r in components.components(simhash.links(df, group=group)).collect()}
    want = _components(fps)
    for a in fps:
        for b in fps:
            same = got.get(signed(a), signed(a)) == got.get(signed(b), signed(b))
            assert same == (want[a] == want[b])


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}
    assert components.components(edges.limit(0)).count() == 0


def test_warc(spark):
    rows = [(3, "http://a/ b\n", "<p>x</p>", 1), (1, None, "<p>x</p>", 1), (2, "u", None, 1), (5, "u", "", 1), (4, "u", "é" * 50_000, 1), (None, "u", "<p>x</p>", 1), (6, "u", "own", 1), (1, "u", "<p>x</p>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha int").repartition(2)
    first = {}
    for p, _, h, _ in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = []
    for p, _, h, _ in rows:
        raw = (h or "").encode()
        refers = first[h or ""] if first[h or ""] != p else None
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if refers is not None else "response", refers))
    manifest = warc.write_archives(pages, most_bytes=600)
    for split in (1 << 20, 100, 37):
        assert sorted(map(tuple, warc.read_archives(manifest, split_bytes=split).collect()), key=key) == sorted(want, key=key)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_damage_is_told(tmp_path):
    """One flipped byte anywhere, a missing tail or a missing record: the read fails, whatever the split."""
    parts = [warc.record(k, "u", (f"page {k} " * 30).encode()) for k in range(6)]
    data, f = b"".join(parts), tmp_path / "a.warc.gz"
    starts = np.cumsum([0] + [len(p) for p in parts])

    def read(raw, split):
        f.write_bytes(raw)
        return [at for a in range(0, len(data), split) for at, _ in warc.members(str(f), a, min(a + split, len(data)), strict=True)]

    for split in (1 << 20, 97, 300):
        assert read(data, split) == starts[:-1].tolist()
        for at in (0, 1, 2, *starts[1:-1], starts[2] + 1, starts[3] + 12, starts[4] + 60, len(data) - 5):
            bad = bytearray(data)
            bad[at] ^= 0xFF
            with pytest.raises(warc.DamagedArchive):
                read(bytes(bad), split)
        with pytest.raises(warc.DamagedArchive):
            read(data[:-9], split)


def test_unigram_pieces_equal_the_library(tmp_path):
    """A unigram model written by hand (no tokenizer is trained): pieces with scores, an unknown piece, no byte pieces."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    r = random.Random(6)
    model = proto.ModelProto()
    kind = proto.ModelProto.SentencePiece
    for piece, t in (("<unk>", kind.UNKNOWN), ("<s>", kind.CONTROL), ("</s>", kind.CONTROL)):
        model.pieces.add(piece=piece, score=0.0, type=t)
    words = {"".join(r.choice("abc▁") for _ in range(r.randrange(2, 6))).replace("▁▁", "▁") for _ in range(120)} | set("abc▁")
    for w in sorted(w for w in words if "▁" not in w[1:]):
        model.pieces.add(piece=w, score=-r.random() * 12 - 0.1, type=kind.NORMAL)
    model.trainer_spec.model_type = 1
    model.normalizer_spec.add_dummy_prefix = True
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = True
    path = tmp_path / "own.model"
    path.write_bytes(model.SerializeToString())
    own, library = sentencepieces.PieceCoder(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    assert own.unigram
    for _ in range(1500):
        t = "".join(r.choice("aaabbbccc  d") for _ in range(r.randrange(0, 40)))
        got, want = np.frombuffer(own.encode(t), "<i4").tolist(), library.encode(t)
        # pieces in another order have the same sum, which the library rounds to 32 bits on the way
        assert got == want or (sorted(got) == sorted(want) and own.unknown not in got), t


def test_warc_passes_false_magic(tmp_path):
    data = b"".join([b"\x1f\x8b\x08 no member", warc.record(1, "u", b"\x1f\x8b\x08" * 50), b"\x1f\x8b\x08", warc.record(2, "u", zlib.compress(b"y" * 99))])
    f = tmp_path / "a.warc.gz"
    f.write_bytes(data)
    for step in (11, 64, len(data)):
        got = [warc.parse(raw)["page_id"] for a in range(0, len(data), step) for _, raw in warc.members(str(f), a, min(a + step, len(data)))]
        assert got == [1, 2]


def test_decontamination(spark, docs, empty):
    items = [(1, "the Rain, of SUN moon tree river stone light wind cloud sun"), (2, "one two"), (3, ""), (4, None), (2, "café"), (None, "a b c d e f g h i j k")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    extra = [(20, "x the rain of sun moon tree river stone light wind cloud sun! y"), (21, "One... TWO three"), (22, "a b c d e f g h i j k l"), (23, "rain of sun moon tree river stone light wind")]
    all_docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    want = []
    for i, t in [*_texts(), *extra]:
        w, hit, found = cut(t), set(), set()
        for g, ids in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= ids
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    for most, broadcast in ((50_000, 10**6), (1, 10**6), (1, 1)):  # the set in the plan, as a broadcast table, and the join beyond
        assert sorted(map(tuple, decontamination.report(all_docs, bench, most_hashes=most, most_broadcast=broadcast).collect()), key=key) == sorted(want, key=key)
    assert decontamination.report(empty, bench).count() == 0
    assert decontamination.report(docs, bench.limit(0)).where("contaminated").count() == 0
    wide = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    kept = decontamination.decontaminate(wide, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not x[5] for x in want)
    spans = {r.doc_id: r.text for r in decontamination.decontaminate(wide, bench, remove="spans").where("doc_id >= 20 and doc_id < 30").collect()}
    assert spans == {20: "x! y", 21: " three", 22: " l", 23: extra[3][1]}


def _line_rules(rows):
    """Lines that stay, per row, by templates() alone."""
    seen, first = Counter(), {}
    for i, t in rows:
        for k in {k for line in (t or "").split("\n") for k in line_dedup.templates(line)}:
            seen[k] += 1
            if i is not None:
                first[k] = min(i, first.get(k, i))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None))
            continue
        out.append((i, "\n".join(x for x in t.split("\n") if not any(seen[k] > 1 and first.get(k) != i for k in line_dedup.templates(x)))))
    return out


def test_line_dedup(docs, empty):
    got = line_dedup.drop_recurring(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    rows = got.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=key) == sorted(_line_rules(_texts()), key=key)
    assert all(r.n_chars == len(r.text or "") for r in rows)
    assert line_dedup.drop_recurring(empty).count() == 0


def test_templates_generalise():
    t = line_dedup.templates
    assert t("user 17 logged in") == t("user 99 logged in") != t("user 17 logged out")
    assert t("a b") == []
    line = "on this day the ship came home with salt and grain and one old dog".split()
    other = [*line[:9], "iron", *line[10:]]
    assert set(t(" ".join(line))) & set(t(" ".join(other)))
    far = [w + "x" if k % 4 == 3 else w for k, w in enumerate(line)]
    assert not set(t(" ".join(line))) & set(t(" ".join(far)))


def test_text_counts():
    f = quality_rules.text_counts
    assert f(None) == f("") == (0, 0, 0, 0, 0)
    assert f("a b c d a b c\nx\nx\n\n") == (9, 9, 0, 1, 6)
    assert f("$5 <b>|&\xa0é") == (2, 9, 5, 0, 0)  # a no-break space is part of a word
    words = [random.Random(2).choice("abc") for _ in range(200)]
    text = " ".join(words)
    wins = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {k + j for k in range(198) if wins[tuple(words[k : k + 3])] > 1 for j in range(3)}
    assert f(text)[4] == len(hit)


def _kneser_ney(texts):
    """Plain modified Kneser-Ney over code points: a function from four codes to the log probability of the last."""
    def coded(t):
        c = [ord(x) if ord(x) < 65536 else 0xFFFD for x in t]
        return [2, 2, 2, *c, 3]

    counts = {4: Counter()}
    for t in texts:
        c = coded(t)
        counts[4].update(tuple(c[i : i + 4]) for i in range(len(c) - 3))
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts, total, given = {}, {}, {}
    for k, own in counts.items():
        n = Counter(own.values())
        if n[1] * n[2] * n[3] * n[4]:
            y = n[1] / (n[1] + 2 * n[2])
            cuts[k] = [max(0.0, min(float(i), i - (i + 1) * y * n[i + 1] / n[i])) for i in (1, 2, 3)]
        else:
            cuts[k] = [0.5, 1.0, 1.5]
        for g, v in own.items():
            total[k, g[:-1]] = total.get((k, g[:-1]), 0) + v
            given[k, g[:-1]] = given.get((k, g[:-1]), 0.0) + v - cuts[k][min(v, 3) - 1]

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(counts[1]) + 1)
        own = counts[k][g]
        return (own - cuts[k][min(own, 3) - 1]) / total[k, g[:-1]] + (1 - given[k, g[:-1]] / total[k, g[:-1]]) * p(g[1:])

    def score(g):
        k = len(g)
        if not k:
            return -20.0
        if counts[k][g]:
            return float(np.log(p(g)))
        rest = float(np.log(max(1 - given[k, g[:-1]] / total[k, g[:-1]], 1e-9))) if (k, g[:-1]) in total else 0.0
        return rest + score(g[1:])

    return coded, score


def test_language_model_equals_a_plain_one(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("abcdé 漢🎉"[: 5 + k % 4]) for _ in range(r.randrange(0, 160))) for k in range(200)]
    model = ngram_model.store(spark.createDataFrame([(t,) for t in [*texts, None]], "`a.b` string").repartition(3), text="a.b")
    coded, score = _kneser_ney(texts)
    for t in [*texts, "", "zebra", "abcd" * 40, "漢 é🎉z"]:
        c = coded(t)
        want = [score(tuple(c[i : i + 4])) for i in range(len(c) - 3)]
        assert np.allclose(model.log_probs(ngram_model.joined([t])[0]), want, atol=2e-5)
    codes = sorted({x for t in texts for x in coded(t)} - {2})
    for ctx in ((97, 98, 99), (2, 2, 97), (32, 32, 32)):  # what the one share of an unseen code leaves
        g = np.array([ctx[0] << 48 | ctx[1] << 32 | ctx[2] << 16 | c for c in codes], dtype=np.uint64)
        assert 0.9 < np.exp(model.log_probs(g)).sum() <= 1 + 1e-5


def test_rare_languages_are_judged(spark):
    """The verdict against a plain model, medians and deviations; three Dutch documents take the band of all."""
    r = random.Random(8)
    clean = lambda: " ".join(r.choice(["sun", "moon", "river", "stone", "cloud", "light", "tree"]) + r.choice("abcde") for _ in range(90))
    rows = [(f"d{k}", clean(), ("en", "de")[k % 2]) for k in range(60)] + [("n1", clean(), "nl"), ("n2", " ".join(w + "$%&" for w in clean().split()), "nl"), ("n3", " ".join(f"{k}q§" for k in range(90)), None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string").repartition(3)
    got = {x.doc_id: x for x in quality_rules.judge(df).collect()}
    coded, score = _kneser_ney([t for _, t, _ in rows])
    letters = lambda t: sum(c.isalnum() for c in t)
    ppl = {}
    for i, t, _ in rows:
        c = coded(t)
        ppl[i] = -sum(score(tuple(c[k : k + 4])) for k in range(len(c) - 3)) / letters(t)
        assert got[i].log_ppl == pytest.approx(ppl[i], abs=1e-4)
    band = {}
    for name in ("en", "de", None):
        own = [round(got[i].log_ppl * 1000) for i, _, at in rows if name in (None, at)]
        mid = float(np.median(own))
        half = 6 * max(0.03, 1.4826 * float(np.median(np.abs(np.array(own) - mid))) / 1000)
        band[name] = (mid / 1000 - half, mid / 1000 + half)
    for i, _, at in rows:
        low, high = band.get(at, band[None])
        assert (got[i].low, got[i].high) == pytest.approx((low, high), abs=2e-3) and got[i].kept == (low <= got[i].log_ppl <= high)
    assert got["n1"].kept and not got["n2"].kept and not got["n3"].kept
    assert {x.doc_id for x in quality_rules.keep_good(df).collect()} == {i for i, x in got.items() if x.kept}


def test_quality_rules(spark, docs, empty):
    r = random.Random(8)
    clean = lambda: " ".join(r.choice(["sun", "moon", "river", "stone", "cloud", "light", "tree"]) + r.choice("abcde") for _ in range(120))
    rows = [(100 + k, clean(), "en") for k in range(60)] + [(200, " ".join(w + "$%&" for w in clean().split()), "en"), (201, clean(), None)]
    every = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = quality_rules.judge(every).collect()
    assert len(got) == len(rows) + len(_texts())
    text = Counter((i, quality_rules.text_counts(t)) for i, t in _texts())
    own = Counter((x.doc_id, (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words)) for x in got if x.doc_id is None or x.doc_id < 100 or x.doc_id > 300)
    assert own == text
    assert all(x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words) for x in got)
    verdict = {x.doc_id: x.kept for x in got}
    assert all(verdict[100 + k] for k in range(60)) and not verdict[200] and verdict[201] and not verdict[10]
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert quality_rules.judge(empty).count() == 0


def test_sharding(spark, docs, empty):
    store = sharding.ShardStore(spark, new_dir(spark, "test-shards"), target_bytes=1 << 20)
    for k in range(3):
        store.append(docs.where(f"coalesce(doc_id, 0) % 3 = {k}"))
    before = store.manifest()
    version = store.compact()
    now = store.manifest()
    assert version == now["version"] > before["version"] and len(now["shards"]) < len(before["shards"])
    same = lambda df: sorted(map(str, df.collect()))
    assert same(store.read()) == same(docs) == same(store.read(before["version"]))
    with pytest.raises(sharding.CommitConflict):
        store._commit(now["version"], now["schema"], [])
    with pytest.raises(ValueError):
        store.append(docs.select("doc_id"))
    store.append(empty)
    assert store.vacuum() > 0 and same(store.read()) == same(docs)
    assert store.compact(everything=True) >= version and same(store.read()) == same(docs)


def test_sentencepieces(docs, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = [(i, len(ids := library.encode(t or "")), ids, library.decode(ids)) for i, t in _texts()]
    got = [tuple(r) for r in sentencepieces.encode(docs, PIECES).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    back = sentencepieces.decode(sentencepieces.encode(docs, PIECES, decoded=False), PIECES)
    assert sorted((r.decoded for r in back.collect())) == sorted(t or "" for _, t in _texts())
    assert sentencepieces.encode(empty, PIECES).count() == 0


def test_sentencepieces_equal_the_library_on_random_text():
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepieces.PieceCoder(PIECES, limit=50)
    r = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz   .,'\"()-_=/0123456789\n\tABCÄöéß▁漢🎉\x00"
    for _ in range(1500):
        t = "".join(r.choice(letters) for _ in range(r.randrange(0, 90)))
        ids = np.frombuffer(own.encode(t), "<i4").tolist()
        assert ids == library.encode(t) and own.decode(ids) == library.decode(ids)


def test_unigram_pass_finds_the_best_score():
    own = sentencepieces.PieceCoder(PIECES, unigram=True)
    r = random.Random(6)
    for _ in range(200):
        t = "▁" + "".join(r.choice("theandrio") for _ in range(r.randrange(1, 14)))
        best = [0.0] + [-1e300] * len(t)
        for e in range(1, len(t) + 1):
            for s in range(e):
                if (i := own.ids.get(t[s:e])) is not None:
                    best[e] = max(best[e], best[s] + own.scores[i])
        assert sum(own.scores[i] for i in own._unit(t)) == pytest.approx(best[-1])


def test_pu_risk_and_gradients():
    r = np.random.default_rng(1)
    for shift, prior in ((0.0, 0.4), (-4.0, 0.9)):  # the second turns the negative part below 0
        fp, fu = r.normal(1, 1, 7), r.normal(shift, 1, 9)
        loss = lambda f: np.log1p(np.exp(-f)).mean()
        part = lambda p, u, prior=prior: loss(-u) - prior * loss(-p)
        value, gp, gu = quality_classifier.pu_risk(fp, fu, prior)
        assert (part(fp, fu) < 0) == (shift < 0)
        assert abs(value - prior * loss(fp) - max(0, part(fp, fu))) < 1e-12
        goal = (lambda p, u, prior=prior: prior * loss(p) + part(p, u)) if shift == 0 else (lambda p, u: -part(p, u))
        for f, g, at in ((fp, gp, 0), (fu, gu, 1)):
            for k in range(len(f)):
                step = np.zeros(len(f))
                step[k] = 1e-5
                up, down = ((f + step, fu), (f - step, fu)) if at == 0 else ((fp, f + step), (fp, f - step))
                assert abs((goal(*up) - goal(*down)) / 2e-5 - g[k]) < 1e-7


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_prior_from_positives_and_unlabelled(share):
    r = np.random.default_rng(2)
    draw = lambda n, at: r.normal(at, 1, (n, quality_classifier.N_FEATURES))
    n = int(4000 * share)
    got = quality_classifier.estimate_prior(draw(2000, 0.0), np.concatenate([draw(n, 0.0), draw(4000 - n, 1.5)]))
    assert abs(got - share) < 0.06
    assert quality_classifier.estimate_prior(draw(0, 0.0), draw(9, 0.0)) == 0.5


def test_classifier(spark, docs, empty):
    r = random.Random(3)
    good = lambda: " ".join(r.choice(WORDS[:14]) + r.choice("abcdefgh") for _ in range(r.randrange(30, 200)))
    bad = lambda: " ".join([r.choice(WORDS) + "$$$"] * 80)
    rows, marks = [], []
    for k in range(900):
        junk = k % 6 == 0
        rows.append((k, bad() if junk else good()))
        if k % 5 < 2:  # the labelled rows hold as much junk as the others: their share of 1 is the prior
            marks.append((k, 1 - int(junk), 0))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([*marks, (3, None, 0), (1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(d, y)
    got = quality_classifier.score(d, model).collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    truth = {k: int(k % 6 != 0) for k in range(900)}
    assert np.mean([x.predicted == truth[x.doc_id] for x in got if x.held_out]) > 0.95
    odd = quality_classifier.score(docs, model)
    assert odd.count() == len(_texts()) and odd.where("score is null").count() == 0
    assert quality_classifier.score(empty, model).count() == 0
    none = quality_classifier.fit(d, y.limit(0))
    assert {x.score for x in quality_classifier.score(d, none).collect()} == {0.5}


def test_stored_model_keeps_rare_grams(spark):
    """Grams far below 1/2^19 of all keep their place."""
    r = random.Random(3)
    texts = ["".join(r.choice("abcdef ") for _ in range(700)) for _ in range(1800)] + ["rare 漢字 words, once only"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    model, (g, _, _) = ngram_model.store(df), ngram_model.joined(texts)
    assert len(g) > 2 << 19
    for k in range(1, ngram_model.ORDER + 1):
        assert spark.read.parquet(model.probs[k - 1][0]).count() == len(np.unique(g & np.uint64((1 << 16 * k) - 1)))
    n = np.array([0, 1, -1, 2**40, -(2**62)])
    assert [r.h for r in spark.createDataFrame([(int(v),) for v in n], "n long").selectExpr("xxhash64(n) AS h").collect()] == ngram_model.spark_hash(n.view(np.uint64)).view(np.int64).tolist()


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "benchmark decontamination", "SentencePiece"]
    d = docs
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        d = f(spark, d, "/root/testdata/sf0.001")
        if k < 4:
            assert d.columns == docs.columns
    assert d.columns == ["doc_id", "n_pieces", "ids", "decoded"]
    assert d.count() <= docs.count()
