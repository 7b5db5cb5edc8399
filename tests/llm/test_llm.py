"""Training-data operators against brute force, round trips and held-out accuracy, with odd inputs."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from laureate.llm import bpe, common, mixing, quality, queries, repetition, simhash, suffix_dedup, token_rollup, topk, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, k1 int"
PASSAGE = "The quick brown fox jumps over the lazy dog while seventeen careful engineers write exact tests for every odd case that comes to mind, " * 2
ODD = [
    (1, "Alpha beta gamma delta " * 3, "en", "a", 1, "x", 1),
    (2, None, None, None, None, None, None),
    (3, "", "en", "b", 0, "x", 1),
    (4, " \n\t ", "en", "b", 4, "x", 1),
    (5, "alpha Beta gamma delta " * 3, "en", "a", 1, "x", 1),
    (5, "alpha Beta gamma delta " * 3, "en", "a", 1, "x", 1),
    (None, "no id here at all", "en", None, 1, "x", 1),
    (6, PASSAGE + "one end", "en", "c", 1, "x", 1),
    (7, "Some start " + PASSAGE + "naïve ünïcödé 日本語 end", "en", "c", 1, "x", 1),
    (8, "z" * 900, "en", "c", 1, "x", 1),
    (9, "long word list " * 4000, "en", "c", 1, "x", 1),
    (10, "one two", "en", "d", 1, "x", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _fingerprint(t):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode())) if x]
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _groups(pairs_of, n):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in pairs_of:
        a, b = top(i), top(j)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_simhash_equals_brute_force(spark, docs, odd):
    for df in (docs, odd):
        got = simhash.near_groups(df).collect()
        rows = df.select("doc_id", "text").collect()
        fp = [_fingerprint(r["text"]) for r in rows]
        group = _groups(((i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2), len(fp))
        low = {g: min((r["doc_id"] for r, h in zip(rows, group, strict=True) if h == g and r["doc_id"] is not None), default=None) for g in group}
        want = sorted((str(r["doc_id"]), f, str(low[g])) for r, f, g in zip(rows, fp, group, strict=True))
        assert sorted((str(r["doc_id"]), r["fp"] % 2**64, str(r["component_id"])) for r in got) == want


def test_simhash_equals_its_sql(spark, sf_dir, odd):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = queries.op3_simhash(spark, sf_dir)
    want = con.execute(queries.oracle_sql()["op3_simhash"])
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    con.execute("DROP VIEW documents")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r["doc_id"], r["text"]) for r in odd.collect()])
    near = [(r["doc_id"], f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in simhash.near_groups(odd.select("doc_id", "text"), 3, 2).collect()]
    assert sorted(con.execute(queries.oracle_sql()["op3_simhash"]).fetchall(), key=str) == sorted(near, key=str)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 7, 8, 12, 15, 16, 31, 32, 33, 39, 63, 64, 65, 100, 200])
def test_hash_of_the_sql(n):
    s = "".join(chr(97 + i * i % 26) for i in range(n))
    got = duckdb.connect().execute(f"WITH strings AS (SELECT '{s}' AS s), {queries._hashed()} SELECT h::UBIGINT FROM hashes").fetchone()
    assert got == (xxhash.xxh64_intdigest(s.encode(), 42),)


def test_simhash_splits_hot_sets_without_loss(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**62, 4, np.uint64)
    fps = {int(base[i % 4]) ^ sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 4), replace=False)) for i in range(900)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = simhash.links(df, common.shared_dir(spark), radius=2, most=40)
    root = {r["node"]: r["root"] for r in common.components(found, common.shared_dir(spark)).collect()}
    group = _groups(((i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2), len(fps))
    assert [root.get(f, f) for f in fps] == [fps[g] for g in group]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (7, 6)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "u long, v long"), common.shared_dir(spark)).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}


def test_one_of_each_group_stays(odd, none):
    kept = sorted((r["doc_id"] or -1) for r in simhash.one_of_each(odd).collect())
    assert kept == [-1, 1, 2, 6, 7, 8, 9, 10]
    assert simhash.one_of_each(none).columns == none.columns and simhash.one_of_each(none).count() == 0


def test_one_of_each_finds_all_similar_texts(spark):
    rng = np.random.default_rng(4)
    texts = []
    for i in range(90):
        words = [f"w{x}" for x in rng.integers(0, 5000, (60, 100, 300)[i % 3])]
        texts.append(" ".join(words))
        for changed in (1, len(words) // 50, len(words) // 25):
            copy = list(words)
            for at in rng.choice(len(words), changed, replace=False):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = sorted(set(_groups(pairs, len(texts))))
    assert 90 < len(want) < len(texts) and len(pairs) > 150
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == want
    tiled = {r["doc_id"]: r["component"] for r in simhash.similar_groups(docs.limit(60), tile=2).collect()}
    whole = {r["doc_id"]: r["component"] for r in simhash.similar_groups(docs.limit(60)).collect()}
    assert tiled == whole


def test_similar_texts_are_found_by_their_simhash(spark):
    """Links by the wide fingerprint: those of all pairs that share a block and lie within the radius, split sets included; every pair of similarity 0.8 is
    joined, of short texts too, and unrelated texts are not."""
    rng = np.random.default_rng(8)
    sets = []
    for i in range(150):
        h = rng.integers(0, 2**63, (4, 8, 20, 200)[i % 4], np.uint64)
        more = rng.integers(0, 2**63, len(h) // 4, np.uint64)
        sets += [np.sort(h), np.sort(np.concatenate([h, more]))]
    fps = [simhash.wide_bits(h) for h in sets]
    keys = [set(simhash.dealt_by(h, f).tolist()) for h, f in zip(sets, fps, strict=True)]
    apart = lambda i, j, n: int((fps[i][:n] != fps[j][:n]).sum())
    want = _groups(((i, j) for i in range(len(sets)) for j in range(i) if keys[i] & keys[j] and apart(i, j, 64) <= simhash.NEAR_FIRST and apart(i, j, 192) <= simhash.NEAR), len(sets))
    assert want == [i // 2 * 2 for i in range(len(sets))]
    rows = [(i, np.packbits(f[:192]).view(np.int64).tolist(), sorted(k)) for i, (f, k) in enumerate(zip(fps, keys, strict=True))]
    nodes = spark.createDataFrame(rows, "node long, fp array<long>, blocks array<int>")
    for most in (8192, 2):
        root = {r["node"]: r["root"] for r in common.components(simhash.near_links(nodes, most), common.shared_dir(spark)).collect()}
        assert [root.get(i, i) for i in range(len(sets))] == want


def test_links_of_near_copies_grow_with_the_copies(spark, monkeypatch):
    """A large group's links are few for each of its members, however many blocks, parts and tiles these share, and join just the groups of brute force."""
    rng = np.random.default_rng(12)
    sets = []
    for size, share in ((300, 0.04), (60, 0.25), (40, 0.45)):
        base = rng.integers(0, 2**63, 200, np.uint64)
        for _ in range(size):
            h = base.copy()
            changed = rng.random(200) < share * rng.random()
            h[changed] = rng.integers(0, 2**63, changed.sum(), np.uint64)
            sets.append(np.sort(h))
    fps = np.array([simhash.wide_bits(h) for h in sets])
    keys = [set(simhash.dealt_by(h, f).tolist()) for h, f in zip(sets, fps, strict=True)]
    near = ((fps[:, None, :64] != fps[None, :, :64]).sum(axis=2) <= simhash.NEAR_FIRST) & ((fps[:, None, :192] != fps[None, :, :192]).sum(axis=2) <= simhash.NEAR)
    want = _groups(((i, j) for i in range(len(sets)) for j in range(i) if near[i, j] and keys[i] & keys[j]), len(sets))
    assert 3 < len(set(want)) < 100 and not near[300:360, 300:360].all()
    rows = [(i, np.packbits(f[:192]).view(np.int64).tolist(), sorted(k)) for i, (f, k) in enumerate(zip(fps, keys, strict=True))]
    nodes = spark.createDataFrame(rows, "node long, fp array<long>, blocks array<int>")
    for most in (8192, 100, 16):
        found = common.stored(simhash.near_links(nodes, most), common.shared_dir(spark))
        root = {r["node"]: r["root"] for r in common.components(found, common.shared_dir(spark)).collect()}
        assert [root.get(i, i) for i in range(len(sets))] == want
        if most > 16:  # in parts of 8 nearly each of the 64 * 38 * 38 / 2 pairs of parts has a link
            assert found.count() < 10 * len(sets)

    made = {}

    def stored(df, path):
        out = common.stored(df, path)
        made[path.rsplit("/", 1)[1]] = out.count()
        return out

    monkeypatch.setattr(simhash, "stored", stored)
    words = [f"w{x}" for x in range(400)]
    docs = spark.createDataFrame([(i, " ".join(words[:i] + ["changed"] + words[i + 1 :])) for i in range(400)], "doc_id long, text string")
    for tile in (20, 512):
        assert len({r["component"] for r in simhash.similar_groups(docs, tile=tile).collect()}) == 1
        assert made["edges"] < 10 * 400 and made["pairs"] < 2 * 400
    fps = sorted({(1 << 45) ^ (1 << a) ^ (1 << b) for a in range(22) for b in range(a)} | {1 << 45})
    assert simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), common.shared_dir(spark), radius=2, most=40).count() < 3 * len(fps)


def test_wide_fingerprint_is_the_majority_of_the_hashes(spark):
    h = np.random.default_rng(9).integers(0, 2**63, 600, np.uint64)
    votes, mask = [0] * (simhash.BLOCKS * simhash.STEP), 2**64 - 1
    for x in h.tolist():
        bits = []
        for seed in simhash._SEEDS.tolist():
            z = (x + seed) & mask
            z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
            bits += [b >> i & 1 for b in (z ^ (z >> 31)).to_bytes(8, "little") for i in range(7, -1, -1)]
        votes = [v + b for v, b in zip(votes, bits, strict=True)]
    assert simhash.wide_bits(h).tolist() == [int(2 * v > len(h)) for v in votes]


def test_one_of_each_keeps_a_row_of_each_group_whatever_its_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (1, b), (2, b), (1, a), (None, c), (None, c), (None, a), (3, d), (3, c)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, a), (1, b), (3, c), (3, d)]


def _cuts(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    for b in data:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()


def test_suffix_dedup_equals_brute_force(spark, docs, odd):
    rng = np.random.default_rng(5)
    bank = ["".join(rng.choice(list("abcd "), 260)) for _ in range(4)]
    edge = [("".join(rng.choice(list("abcd "), rng.integers(0, 60))) + bank[i % 4][rng.integers(0, 70) : rng.integers(200, 260)] + "".join(rng.choice(list("abcd "), rng.integers(0, 60)))) for i in range(80)]
    mixed = spark.createDataFrame([(i, t) for i, t in enumerate(edge)], "doc_id long, text string")
    for df in (docs.limit(120), odd, mixed):
        rows = df.select("doc_id", "text").collect()
        df = spark.createDataFrame(rows, "doc_id long, text string")
        want = sorted((str(r["doc_id"]), *c) for r, c in zip(rows, _cuts([r["text"] for r in rows], 200), strict=True))
        assert sorted((str(r["doc_id"]), *list(r)[1:]) for r in suffix_dedup.cut_digest(df).collect()) == want


def test_suffix_dedup_equals_its_sql(spark, sf_dir, odd):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = queries.op4_suffix_dedup(spark, sf_dir)
    want = con.execute(queries.oracle_sql()["op4_suffix_dedup"])
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    con.execute("DROP VIEW documents")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = [(i, *c) for (i, _), c in zip(rows, _cuts([t for _, t in rows], 200), strict=True)]
    assert sorted(con.execute(queries.oracle_sql()["op4_suffix_dedup"]).fetchall(), key=str) == sorted(want, key=str)


def test_later_batches_are_matched_with_all_before(spark, odd, none):
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcd "), n))
    bank = [word(320) for _ in range(6)]
    part = lambda: bank[rng.integers(6)][rng.integers(0, 80) : rng.integers(240, 320)]
    batches = [[(100 * b + i, word(rng.integers(0, 50)) + (part() if rng.random() < 0.4 else word(260)) + word(rng.integers(0, 50))) for i in range(12)] for b in range(4)]
    batches.insert(2, [tuple(r) for r in odd.select("doc_id", "text").collect()])
    batches.append([batches[0][0], (900, batches[1][1][1][3:])])  # a row that came before, and most of a text that did
    index, before = suffix_dedup.SubstringIndex(spark), []
    assert index.add(none).count() == 0
    for rows in batches:
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted((r["k1"], r["n_bytes"], sum(s["e"] - s["s"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in index.add(df).collect())
        before += rows
        cuts = list(_cuts([t for _, t in before], 200))[-len(rows) :]
        assert got == sorted((suffix_dedup.NO_ID if i is None else i, *c) for (i, _), c in zip(rows, cuts, strict=True))
    assert sorted(index.family.levels) == [1, 2, 4]
    level, probe = spark.table(index.family.levels[4]), spark.range(9).selectExpr("id AS key", "cast(id % 3 AS int) AS salt").hint("merge")
    plan = level.join(probe, ["key", "salt"], "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1, plan  # the level is scanned as it lies
    index.close()
    assert not index.family.tables


def test_suffix_levels_double(spark):
    family = suffix_dedup.SuffixFamily(spark, 4)
    for i in range(5):
        family.add(spark.createDataFrame([(j,) for j in range(i, i + 3)], "key long"))
    assert sorted(family.levels) == [1, 4]
    family.close()


def test_long_texts_are_cut_in_segments(monkeypatch):
    rng = np.random.default_rng(2)
    data = bytes(rng.integers(97, 101, 5000, dtype=np.uint8))
    whole = suffix_dedup.anchors(data)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    parts = suffix_dedup.anchors(data)
    assert whole["n"].sum() == parts["n"].sum() == 4801
    assert set(whole["key"].tolist()) == set(parts["key"].tolist())


def test_cleaned_keeps_rows_and_columns(odd, none):
    out = suffix_dedup.cleaned(odd)
    assert out.columns == odd.columns
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[10]["text"] == "one two" and by[7]["text"].endswith("日本語 end") and PASSAGE[:200] not in by[6]["text"]
    assert by[2]["text"] is None and by[8]["text"] == ""
    assert suffix_dedup.cleaned(none).count() == 0


@pytest.fixture(scope="session")
def library():
    with open(queries.VOCABULARY, "rb") as f:
        return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(f.read()), special_tokens={})


def test_bpe_equals_library_and_round_trips(spark, docs, odd, library):
    extra = spark.createDataFrame([(i, t) for i, t in enumerate(["  a  b \n\n c ", "'ll don't I'm", "\n", "\0\nx y", " hello world　 x", "a\tb", "tab\n\nx.  y", "12 345,678!!"])], "doc_id long, text string")
    for df in (docs.limit(60).select("doc_id", "text"), odd.select("doc_id", "text"), extra):
        rows = df.collect()
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
        want = sorted((str(r["doc_id"]), library.encode_ordinary(r["text"] or "")) for r in rows)
        coded = bpe.encode(df, queries.VOCABULARY, P.PATTERN)
        assert sorted((str(r["doc_id"]), r["ids"]) for r in coded.collect()) == want
        back = bpe.decode(coded, queries.VOCABULARY, P.PATTERN)
        assert sorted((str(r["doc_id"]), bytes(r["decoded"]).decode()) for r in back.collect()) == sorted((str(r["doc_id"]), r["text"] or "") for r in rows)
        digest = bpe.encode(df, queries.VOCABULARY, P.PATTERN, digest=True).collect()
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert sorted((str(r["doc_id"]), r["ids_sha256"], r["decoded_sha256"]) for r in digest) == sorted((str(r["doc_id"]), sha(",".join(map(str, library.encode_ordinary(r["text"] or ""))).encode()), sha((r["text"] or "").encode())) for r in rows)


def test_bpe_long_pieces_and_other_patterns(library):
    rng = np.random.default_rng(3)
    with open(queries.VOCABULARY, "rb") as f:
        data = f.read()
    own = bpe.Codec(data, P.PATTERN)
    long = ["z" * 50_000, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 50_000)), "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 8000))), "ab" * 3000 + "q" + "abc" * 2000, "=" * 3001, " " * 4000 + "a"]
    decimal, back = own.encode(long)
    assert [list(map(int, x.split(","))) for x in decimal] == [library.encode_ordinary(x) for x in long] and back == [x.encode() for x in long]
    cased = r"[A-Z]?[a-z]+|\s+|[^\sA-Za-z]+|[A-Z]"
    other = tiktoken.Encoding("other", pat_str=cased, mergeable_ranks=own.ranks, special_tokens={})
    text = "hello World fooBar baz.\n\nABC  x"
    assert bpe.Codec(data, cased).encode([text])[0][0] == ",".join(map(str, other.encode_ordinary(text)))


def test_bpe_forgets_and_learns_again(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    with open(queries.VOCABULARY, "rb") as f:
        own = bpe.Codec(f.read(), P.PATTERN)
    for i in range(6):
        texts = [f"some words number {i} {j} repeat{j % 5}ing" for j in range(30)]
        assert own.encode(texts)[0] == [",".join(map(str, library.encode_ordinary(t))) for t in texts]
        assert len(own.old) <= 100


def test_bpe_of_an_empty_table(none):
    assert bpe.encode(none, queries.VOCABULARY, P.PATTERN, digest=True).count() == 0


def test_topk_ties_nulls_and_blocks(spark):
    v = [(i, [float(i % 5), 1.0]) for i in range(40)] + [(100, None), (101, [None, 1.0]), (102, [float("nan"), 1.0]), (103, [float("inf"), 0.0]), (None, [1.0, 1.0]), (3, [3.0, 1.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").repartition(7)
    got = collections.defaultdict(list)
    for r in sorted(topk.search(df, F.col("vec_id") % 3 == 0, k=4, block=3, tile=5, shard=4, held=12, fan_in=2).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    fine = [(i, [int(x * 1024) for x in e]) for i, e in v if i is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    for q, e in fine:
        if q % 3 == 0:
            best = sorted((-sum(a * b for a, b in zip(e, f, strict=True)), i) for i, f in fine if i != q)[:4]
            assert got[q] == [(i, -s) for s, i in best]
    assert topk.search(df.limit(0), F.col("vec_id") % 3 == 0).count() == 0
    extra = df.withColumns({c: F.lit("x") for c in ("v", "_x", "g", "part", "cell", "is_row", "label")})
    assert topk.search(extra, F.col("vec_id") % 3 == 0, k=4).count() == len(got) * 4


def test_topk_of_repeated_ids_and_other_lengths(spark):
    v = [(0, [2.0, 1.0]), (0, [1.0, 5.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0, 1.0]), (6, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"] >> 20) for r in topk.search(df, F.col("vec_id") % 3 == 0, k=2).collect()}
    assert got == {(0, 1): (2, 5), (0, 2): (1, 1), (3, 1): (6, 3), (6, 1): (3, 3)}
    many = spark.createDataFrame([(i, [float(i % 7)] * (1 + i % 3)) for i in range(90)], "vec_id long, embedding array<float>")
    lists = [sorted(map(tuple, topk.search(many, F.col("vec_id") % 2 == 0, k=3, **how).collect())) for how in ({}, {"held": 10, "shard": 5, "tile": 2, "block": 2})]
    assert lists[0] == lists[1] and len(lists[0]) == 45 * 3


def test_topk_holds_queries_and_streams_rows():
    """However many rows a task is sent, it keeps fewer than a tile and a batch of them."""
    cell = topk._Cell(0, 2, 4, 8)
    part = lambda is_row, ids: pa.RecordBatch.from_pydict({"cell": [0] * len(ids), "is_row": [is_row] * len(ids), "vec_id": pa.array(ids), "v": [[i, 1] for i in ids]})
    cell.add(part(0, [1, 2, 3]), 0)
    for at in range(0, 300, 5):
        cell.add(part(1, list(range(at, at + 5))), 1)
        assert sum(len(ids) for (is_row, _), held in cell.waiting.items() if is_row for ids, _ in held) < 8
    assert cell.asked[2].found.shape == (3, 2)
    got = [tuple(r.values()) for b in cell.lists() for r in b.to_pylist()]
    assert got == [(0, q, i, q * i + 1) for q in (1, 2, 3) for i in (299, 298)]


@pytest.mark.parametrize("pattern,text,fits", [("*.org\n/a*", "x.org\n/ab", True), ("*.org\n/a*", "org\n/ab", False), ("a*b*c", "aXbYc", True), ("a*b*c", "aXbY", False), ("*", "", True), ("", "", True), ("ab", "abc", False), ("*ab*", "xxabxx", True)])
def test_automaton(pattern, text, fits):
    own = url_filter.Automaton(["zzz", "q" * 70, pattern])
    for others in ([b"zzz"], [b"zzz" * i for i in range(1, 30)]):  # finished by themselves, and side by side
        got = own.match([text.encode(), *others])
        assert got[0, 2] == fits and got[1].tolist()[:2] == [True, False]


def test_automaton_equals_plain_patterns():
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("ab*"), n))
    patterns = [word(rng.integers(0, 9)) for _ in range(150)]
    strings = ["".join(rng.choice(list("ab"), rng.integers(0, 14))) for _ in range(60)]
    want = [[re.fullmatch(".*".join(map(re.escape, p.split("*"))), s) is not None for p in patterns] for s in strings]
    assert url_filter.Automaton(patterns).match([s.encode() for s in strings]).tolist() == want


def test_urls_of_any_length_and_many_rules(spark, none):
    import time

    long = "http://a.com/fr/" + "x/" * 500_000
    urls = [(1, long), (1, long), (2, "http://m.b.com/de/" + "é" * 300_000), (3, "http://c.net/" + "y" * 200_000 + "/feed"), (4, "http://c.net/y"), (None, ""), (5, "https://s7.host/p7/x")]
    rows = spark.createDataFrame([(i, u, "h", "r", "v") for i, u in urls], "page_id long, url string, host string, rule string, verdict string").coalesce(1)
    began = time.time()
    got = sorted((r["page_id"] or 0, r["rule"], r["verdict"], len(r["path"])) for r in url_filter.judge_urls(rows, queries.RULES, queries.GLOBS).collect())
    assert got == [(0, None, "allow", 0), (1, "com/fr/", "allow", 1_000_004), (1, "com/fr/", "allow", 1_000_004), (2, "com/de/", "block", 300_004), (3, None, "block", 200_006), (4, None, "allow", 2), (5, None, "allow", 5)]
    many = tuple(url_filter.parse_rule("block", f"s{i}.host/p{i}/") for i in range(5000))
    assert {r["page_id"]: r["rule"] for r in url_filter.judge_urls(rows.where("length(url) < 100"), many).collect()} == {None: None, 4: None, 5: "s7.host/p7/"}
    assert time.time() - began < 60
    assert url_filter.judge_urls(rows.limit(0), queries.RULES).count() == 0


def test_url_verdicts(spark):
    urls = ["http://Example.ORG/es/x", "https://m.example.org/en/17", "http://a.com/fr/", "http://a.com/de/x?y", "http://net/x", None, "no scheme", "http://org", "http://xorg/", "http://org/?#", "http://a.net/login/2", "http://a\nb.org/"]
    rows = url_filter.judge_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), queries.RULES, queries.GLOBS).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert got[0] == ("example.org", "/es/x", "example.org/es/", "block") and got[1][2:] == ("example.org/en/1", "block")
    assert got[2][2:] == ("com/fr/", "allow") and got[3][1:] == ("/de/x", "com/de/", "block")
    assert got[5] == got[6] == ("", "", None, "allow") and got[7] == ("org", "", None, "allow")
    assert got[8][2] is None and got[9][2:] == ("org/", "allow") and got[10][2:] == (None, "block")


def test_mix_targets_by_repeated_sharing(spark, odd, none):
    rng = np.random.default_rng(7)
    sizes = {f"s{i:02}": int(rng.integers(0, 5000) ** 1.5) for i in range(30)} | {None: 900}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    names = [*sorted(s for s in sizes if s), None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while over := [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * sizes[s]]:
        for s in over:
            want[s] = 2.0 * sizes[s]
        open_ -= set(over)
        left = 1.5 * sum(sizes.values()) - sum(want.values())
    want |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
    report = mixing.mix_report(odd).collect()
    assert len(report) == len(ODD) and all(r["taken"] <= 2 * r["size"] for r in report)
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(none).count() == 0
    assert mixing.mix(odd).count() == mixing.mix(odd).count()


def test_mix_comes_near_its_targets(spark, bigger):
    """Each source's words lie within four standard deviations of the copies' chances of its target."""
    rows = collections.defaultdict(list)
    for r in mixing.mix_report(spark.read.parquet(f"{bigger}/documents.parquet")).join(spark.read.parquet(f"{bigger}/documents.parquet").select("doc_id", "source"), "doc_id").collect():
        rows[r["source"]].append(r)
    assert len(rows) > 10
    for of in rows.values():
        rate = of[0]["target"] / of[0]["source_size"]
        part = rate - int(rate)
        deviation = np.sqrt(part * (1 - part) * sum(r["size"] ** 2 for r in of))
        assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= 4 * deviation + 1


def test_columns_with_clashing_names(spark, odd, sf_dir):
    import corpus_pipeline

    clash = odd.withColumns({c: F.lit(77) for c in ("_size", "_target", "_source_size", "size", "target", "of", "copies", "row", "k", "k2", "__a", "__b", "spans", "new", "component", "_kept", "_key", "node", "x", "y", "score")})
    for f in (mixing.mix, suffix_dedup.cleaned, simhash.one_of_each):
        out = f(clash)
        assert out.columns == clash.columns and out.dtypes == clash.dtypes and {r["_size"] for r in out.collect()} == {77}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert quality.accepted(clash, labels).columns == clash.columns and mixing.mix_report(clash).count() == len(ODD)
    for f in (simhash.near_groups, suffix_dedup.cut_digest, repetition.repetition_rules, lambda d: quality.score(d, labels), lambda d: toxicity.score(d, labels.limit(0)), lambda d: corpus_pipeline.tokens(spark, d, sf_dir)):
        assert f(clash).count() == len(ODD)


@pytest.fixture(scope="session")
def bigger():
    return "/root/testdata/sf0.01"


def _held(rows, labels, which, mod, left):
    lab = {r["doc_id"]: r[which] for r in labels}
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % mod == left)
    return [(lab[r["doc_id"]], r) for r in rows if r["held_out"] and r["doc_id"] in lab]


def test_quality_on_held_out_rows(spark, bigger):
    labels = spark.read.parquet(f"{bigger}/labels.parquet").collect()
    held = _held(queries.op8_quality(spark, bigger).collect(), labels, "quality", 5, 0)
    right = sum(y == r["predicted"] for y, r in held)
    assert right >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for _, r in held)


def _plain_statistics(text):
    """The statistics by their description, byte by byte and word by word."""
    data = (text or "").encode()
    n = max(1, len(data))
    kinds = [str.isupper, str.islower, str.isdigit, ".,;:".__contains__, "!?".__contains__, "#*$%&|<>".__contains__, "'\"()[]{}-_/\\+=@^~`".__contains__]
    of = [sum(b < 128 and k(chr(b)) for b in data) for k in kinds]
    of += [sum(b >= 128 for b in data), sum(chr(b) in " \t\n\r\x0b\x0c" for b in data), sum(b == 127 or (b < 32 and chr(b) not in "\t\n\r\x0b\x0c") for b in data)]
    words = re.findall(rb"[^ \t-\r]+", data)
    m = max(1, len(words))
    size = [len(w) for w in words] or [0]
    mean = sum(size) / m
    lines = [x for x in data.split(b"\n") if re.search(rb"[^ \t-\r]", x)]
    count, forms = collections.Counter(data), collections.Counter(words)
    return [np.log(c / n + 1e-3) for c in of] + [
        np.log(1 + len(data)), np.log(1 + mean), np.log(1 + np.sqrt(max(0, sum(x * x for x in size) / m - mean**2) + 1e-9)), np.log((len(forms) + 1) / (m + 1)), np.log(max(forms.values(), default=0) / m + 1e-3),
        np.log(1 - len(set(lines)) / max(1, len(lines)) + 1e-2), np.log(1 + m / max(1, len(lines))), -sum(c / n * np.log(c / n) for c in count.values()), np.log(sum(x > 20 for x in size) / m + 1e-3),
        np.log(sum(x < 3 for x in size if words) / m + 1e-3), np.log(sum(w.isupper() for w in forms) / max(1, len(forms)) + 1e-2),
    ]


def test_quality_statistics_equal_plain_counts(docs, monkeypatch):
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(60).collect()] + [t for _, t, *_ in ODD] + ["a\x00b \x7f", "A BC d\n\n A BC d \n", "w" * 300 + " x", "\u2003é"]
    for part in (1 << 20, 64):
        with monkeypatch.context() as m:
            m.setattr(quality, "segments", lambda data, size=part: common.segments(data, size))
            for t in texts:
                assert np.allclose(quality.statistics(t), _plain_statistics(t), rtol=1e-9, atol=1e-9), repr(t)[:80]


def test_quality_scores_equal_log_densities():
    rng = np.random.default_rng(8)
    n = quality.FEATURES
    mix = [rng.standard_normal((n, n)) * 0.3 for _ in (0, 1)]
    x = {c: rng.standard_normal((60 + 30 * c, n)) @ mix[c] + c for c in (0, 1)}
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    model = quality.fitted({c: {"n": len(v), "s": v.sum(axis=0).tolist(), "p": [float((v[:, i] * v[:, j]).sum()) for i, j in pairs]} for c, v in x.items()})
    every = np.concatenate([x[0], x[1]])
    mean, scale = every.mean(axis=0), every.std(axis=0)
    z, density = (every - mean) / scale, []
    for c in (0, 1):
        own = (x[c] - mean) / scale
        cov = np.cov(own.T, bias=True)
        cov = 0.85 * cov + 0.15 * np.diag(np.diag(cov)) + 0.05 * np.eye(n)
        d = z.clip(-12, 12) - own.mean(axis=0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(len(own)))
    assert np.allclose(model.score(every), 1 / (1 + np.exp(-((density[1] - density[0]) / model.temper + 0).clip(-30, 30))), atol=1e-6)


def test_quality_of_odd_rows(spark, odd, none, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert quality.score(odd, labels).count() == len(ODD)
    assert {r["score"] for r in quality.score(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.score(none, labels).count() == 0 and quality.accepted(odd, labels).columns == odd.columns


def test_toxicity_on_held_out_rows(spark, bigger):
    labels = spark.read.parquet(f"{bigger}/labels.parquet").collect()
    held = _held(queries.op9_toxicity(spark, bigger).collect(), labels, "toxic", 3, 1)
    p, n = [r["score"] for y, r in held if y], [r["score"] for y, r in held if not y]
    assert np.mean([a > b for a in p for b in n]) > 0.75
    # With 33 toxic texts to learn from: most of those held out are found, and hardly any other text is accused.
    assert np.mean([a >= 0.7 for a in p]) >= 0.6 and np.mean([b >= 0.7 for b in n]) <= 0.05


def _network(rng):
    cell = lambda *s: rng.standard_normal(s) * 0.5
    h, e = toxicity.HIDDEN, toxicity.EMBED
    p = {"embed": cell(toxicity.BUCKETS, e), "chars": cell(257, toxicity.CHARS), "k": cell(toxicity.NEAR, toxicity.CHARS, e), "kb": cell(e), "q": cell(e), "qc": cell(1), "a": cell(2 * h, 2 * h), "v": cell(2 * h), "o": cell(2 * h), "c": cell(1)}
    for d in (0, 1):
        p |= {f"w{d}": cell(e, 3 * h), f"u{d}": cell(h, 3 * h), f"b{d}": cell(3 * h)}
    return p


def test_toxicity_gradients():
    rng = np.random.default_rng(1)
    texts, y = ["bad word here", "fine words there now", "bad again"], np.array([1.0, 0.0, 1.0])
    words = toxicity.inputs(texts)
    place, text = toxicity.windows(words.counts)
    p = _network(rng)
    for step, names in ((lambda: toxicity._step(p, words, place, y[text], np.ones(len(text))), ("u0", "w1", "b0", "b1", "a", "v", "o", "c", "k", "kb", "chars")), (lambda: toxicity._step_of_texts(p, words, np.arange(3), y, np.ones(3)), ("q", "qc", "k", "kb"))):

        def loss(step=step):
            z = step()[0]
            return float(np.mean(np.log1p(np.exp(z)) - y * z))

        g = step()[1]
        row = int(g["embed"][0][0])
        for k in (*names, "embed"):
            at = tuple(int(rng.integers(0, n)) for n in p[k].shape)
            at = (row, at[1]) if k == "embed" else (ord("d"), at[1]) if k == "chars" else at
            given = g[k][1][0, at[1]] if k == "embed" else g[k][at]
            own, move = p[k][at], 1e-3
            p[k][at] = own + move
            up = loss()
            p[k][at] = own - move
            down = loss()
            p[k][at] = own
            assert abs((up - down) / (2 * move) - given) < 1e-3 + 0.05 * abs(given), k


def test_toxicity_logits_equal_a_plain_network():
    """Windows, character convolution, both directions and attention, written out word by word."""
    rng = np.random.default_rng(2)
    p = {k: v.astype(np.float32) for k, v in _network(rng).items()}
    texts = ["", "one", "Ünï cödé words, and more! " * 9, " ".join(f"w{i}" for i in range(70))]
    h, e = toxicity.HIDDEN, toxicity.EMBED
    sigma = lambda x: 1 / (1 + np.exp(-x))

    def given(word):
        at = int(toxicity.inputs([word]).bucket[0])
        c = [256] * 2 + list(word.encode()) + [256] * 2
        conv = [p["kb"] + sum(p["chars"][c[i + j]] @ p["k"][j] for j in range(toxicity.NEAR)) for i in range(len(c) - 4)]
        return p["embed"][at] + np.tanh(np.max(conv, axis=0))

    def logit(words):
        x, states = [given(w) for w in words], []
        for d in (0, 1):
            s, out = np.zeros(h), {}
            for t in reversed(range(len(x))) if d else range(len(x)):
                a, b = x[t] @ p[f"w{d}"] + p[f"b{d}"], s @ p[f"u{d}"]
                z, r = sigma(a[:h] + b[:h]), sigma(a[h : 2 * h] + b[h : 2 * h])
                s = out[t] = z * s + (1 - z) * np.tanh(a[2 * h :] + r * b[2 * h :])
            states.append(out)
        both = [np.concatenate([states[0][t], states[1][t]]) for t in range(len(x))] or [np.zeros(2 * h)]
        at = np.array([np.tanh(s @ p["a"]) @ p["v"] for s in both])
        w = np.exp(at - at.max())
        return (w / w.sum()) @ np.array(both) @ p["o"] + p["c"][0]

    want = []
    for t in texts:
        words = re.findall(r"[0-9a-z\x80-\U0010FFFF]+", t.lower())
        starts = range(0, max(1, len(words) - (toxicity.WINDOW - toxicity.STRIDE)), toxicity.STRIDE)
        want.append(max(logit(words[i : i + toxicity.WINDOW]) for i in starts))
    net = toxicity.Network(p, 0.7, 0.1)
    assert np.allclose(toxicity.score_texts(texts, net), sigma(0.7 * np.array(want) + 0.1), atol=1e-4)


def test_toxicity_trains_on_whole_texts(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 300, n)]
    texts = [" ".join(words(900) + ["vile"] * (i % 2) * 20 + words(30)) for i in range(40)]
    y, step, seen = np.arange(40) % 2, toxicity._step, []
    of = toxicity.inputs(texts)
    nth = np.arange(of.counts.sum()) - np.repeat(np.cumsum(of.counts) - of.counts, of.counts)
    monkeypatch.setattr(toxicity, "_step", lambda p, w, place, y, weight: (seen.append((place, y)), step(p, w, place, y, weight))[1])
    net = toxicity.train(texts, y.astype(float), drop=0.0)
    first = {0: set(), 1: set()}
    for place, labels in seen:
        for c in first:
            first[c] |= set(nth[place[labels == c, 0]].tolist())
    assert first[0] == set(range(0, 940, toxicity.STRIDE)[: len(first[0])]) and max(first[1]) > 850
    score = toxicity.score_texts(texts, net)
    assert min(score[1::2]) > max(score[::2])
    docs = spark.createDataFrame([(i, "x" * 30_000) for i in range(20)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    assert {len(r["text"]) for r in toxicity.sample(docs, marks).collect()} == {30_000}


def test_toxicity_of_odd_rows(spark, odd, none, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert toxicity.score(odd, labels.limit(0)).count() == len(ODD) and toxicity.score(none, labels).count() == 0
    counts = np.array([0, 5, 32, 33, 100])
    place, text = toxicity.windows(counts)
    for i, c in enumerate(counts):
        own = place[text == i]
        assert set(own[own >= 0].tolist()) == set(range(counts[:i].sum(), counts[:i].sum() + c)) and len(own) >= 1


def _base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    runs = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)


def _share(t):
    """The largest share of characters in repeats, by its limit, and whether it is kept."""
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    total = max(1, sum(map(len, w)))
    seen, again = set(), 0
    for x in t.split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", x)
        again += sum(map(len, own)) if own and x in seen else 0
        seen.add(x)
    worst = again / total / repetition.LINE_LIMIT
    for n, limit in repetition.LIMITS.items():
        before, inside = set(), set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g in before:
                inside |= set(range(i, i + n))
            before.add(g)
        worst = max(worst, sum(len(w[j]) for j in inside) / total / limit)
    return worst


def test_repetition_equals_brute_force(spark, docs, odd, none):
    more = spark.createDataFrame([(1, "日本語 ü one two three four five\n" * 6 + "end of it all " * 3), (2, "x y\nx y\n\n\na é\na é")], "doc_id long, text string")
    for df in (docs, odd, more):
        rows = df.select("doc_id", "text").collect()
        got = repetition.repetition_rules(df).collect()
        want = sorted((str(r["doc_id"]), *_base(r["text"]), round(_share(r["text"]), 9)) for r in rows)
        assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], round(r["repetition"], 9)) for r in got) == want
        for r in got:
            assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
            assert r["kept"] == (not r["base_failed"] and r["repetition"] <= 1)
    assert repetition.repetition_rules(none).count() == 0


def test_long_texts_are_read_in_parts(monkeypatch):
    text = " ".join(f"wörd{i % 700} x{i}\n" if i % 3 else "same line again\n" for i in range(4000)) + " " + "z" * 3000 + " ende  "
    whole = (simhash.shingles(text, 3).tolist(), quality.statistics(text).round(9).tolist(), repetition.measure(text), toxicity.inputs([text, "a b"])[1].tolist())
    for m in (simhash, quality, repetition):
        monkeypatch.setattr(m, "segments", lambda data: common.segments(data, 500))
    assert (simhash.shingles(text, 3).tolist(), quality.statistics(text).round(9).tolist(), repetition.measure(text), toxicity.inputs([text, "a b"])[1].tolist()) == whole
    assert b"".join(common.segments(text.encode(), 77)) == text.encode() and list(common.segments(b"")) == []


def test_rollup_by_deltas(spark):
    ch = lambda rows: spark.createDataFrame(rows, token_rollup.CHANGE)
    r = token_rollup.TokenRollup(spark)
    first = ch([(0, "insert", 1, "a", "en", "v1", 10), (0, "insert", 2, "a", "en", "v1", 5), (0, "insert", 2, "a", "en", "v1", 5), (1, "revise", 2, "a", "en", "v1", 7), (0, "insert", None, "a", "en", "v1", 9)])
    assert r.commit("one", first) and not r.commit("one", first)
    totals = lambda: {(x["source"], x["lang"], x["tokenizer"]): (x["n_docs"], x["n_tokens"]) for x in r.totals.collect()}
    assert totals() == {("a", "en", "v1"): (2, 17)}
    r.commit("two", ch([(0, "delete", 1, None, None, "v1", None), (0, "delete", 99, None, None, "v1", None), (0, "revise", 98, "a", "en", "v1", 4), (0, "revise", 2, None, "fr", "v1", 3)]))
    assert totals() == {("a", "en", "v1"): (0, 0), (None, "fr", "v1"): (1, 3)}
    again = token_rollup.TokenRollup(spark, r.path)
    assert not again.commit("two", first) and again.totals.count() == 2
    r.commit("three", ch([]))
    assert totals() == {("a", "en", "v1"): (0, 0), (None, "fr", "v1"): (1, 3)}


def test_rollup_of_a_small_batch_writes_little(spark):
    import glob

    ch = lambda rows: spark.createDataFrame(rows, token_rollup.CHANGE)
    r = token_rollup.TokenRollup(spark)
    r.commit("many", ch([(0, "insert", i, "a", "en", "v1", 1) for i in range(20_000)]))
    folders = lambda v: glob.glob(f"{r.path.removeprefix('file://')}/state-{v}/bucket=*")
    written = lambda v: spark.read.parquet(f"{r.path}/state-{v}").count()
    r.commit("some", ch([(0, "revise", 100 * i, "a", "en", "v1", 5) for i in range(200)]))
    assert len(folders(0)) == 32 and written(1) == 200 and r.state.count() == 20_000 and list(r.runs) == [0, 1]
    r.commit("same", ch([(0, "revise", 100, "a", "en", "v1", 5)]))  # changes nothing and writes no run
    assert not folders(2) and list(r.runs) == [0, 1]
    r.commit("one", ch([(0, "delete", 100, None, None, "v1", None)]))
    assert len(folders(3)) == 1 and written(3) == 1 and list(r.runs) == [0, 1, 3]
    r.commit("more", ch([(0, "insert", 100, "b", "en", "v1", 7), (0, "delete", 7, None, None, "v1", None)]))  # takes in the run before
    again = token_rollup.TokenRollup(spark, r.path)
    assert list(again.runs) == list(r.runs) == [0, 1, 4] and written(4) == 2
    for x in (r, again):
        assert {(t["source"], t["n_docs"], t["n_tokens"]) for t in x.totals.collect()} == {("a", 19_998, 19_998 + 199 * 4), ("b", 1, 7)}
        assert x.state.count() == 19_999 and x.state.agg(F.sum("n_tokens")).first()[0] == 19_998 + 199 * 4 + 7


def test_rollup_of_random_batches(spark):
    """Runs merge, hide and drop entries just as one table would."""
    rng = np.random.default_rng(5)
    r, held = token_rollup.TokenRollup(spark, buckets=4), {}
    for n, size in enumerate((9, 1, 2, 30, 3, 12, 1)):
        rows = [(i, str(rng.choice(["insert", "revise", "delete"])), int(rng.integers(12)), str(rng.choice(["a", "b"])), "en", "v", int(rng.integers(50))) for i in range(size)]
        r.commit(str(n), spark.createDataFrame(rows, token_rollup.CHANGE))
        for d in {x[2] for x in rows}:
            mine = [x for x in rows if x[2] == d]
            kind = next((x[1] for x in reversed(mine) if x[1] != "revise"), None)
            new = next(((x[3], x[6]) for x in reversed(mine) if x[1] != "delete"), None)
            if kind == "insert" or (kind is None and d in held):
                held[d] = new
            elif kind == "delete":
                held.pop(d, None)
        assert {x["doc_id"]: (x["source"], x["n_tokens"]) for x in r.state.collect()} == held
        assert {x["source"]: (x["n_docs"], x["n_tokens"]) for x in r.totals.collect() if x["n_docs"]} == {s: (sum(v[0] == s for v in held.values()), sum(v[1] for v in held.values() if v[0] == s)) for s in {v[0] for v in held.values()}}
    sizes = [n for _, n in r.runs.values()]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def test_rollup_of_odd_rows(spark, odd, none):
    r = token_rollup.TokenRollup(spark)
    words = lambda df: token_rollup.changes_of(df, "insert", "w", mixing.word_count())
    r.commit("none", words(none))
    assert r.totals.count() == 0
    clash = odd.withColumns({c: F.lit(1) for c in ("seq", "op", "bucket", "touched", "now", "was")})
    r.commit("odd", words(clash.drop("op")))
    want = {d: (s, lg, len((t or "").split())) for d, t, lg, s, *_ in ODD if d is not None}
    assert {x["doc_id"]: (x["source"], x["lang"], x["n_tokens"]) for x in r.state.collect()} == want
    counted = bpe.counted(odd, queries.VOCABULARY, P.PATTERN).collect()
    assert len(counted) == len(ODD) and {x["n_tokens"] for x in counted if x["doc_id"] in (2, 3)} == {0}


def _accepted(rows, labels):
    """Plain sums of the labelled rows' statistics, and a score for each text."""
    y = {r["doc_id"]: r["quality"] for r in labels if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    got = {}
    for c in (0, 1):
        x = np.array([quality.statistics(r["text"]) for r in rows if y.get(r["doc_id"]) == c])
        got[c] = {"n": len(x), "s": x.sum(axis=0).tolist(), "p": [float((x[:, i] * x[:, j]).sum()) for i in range(quality.FEATURES) for j in range(i, quality.FEATURES)]}
    model = quality.fitted(got)
    return [r for r in rows if model.score(quality.statistics(r["text"])[None])[0] >= 0.3]


def _one_of_each(rows):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((r["text"] or "").lower().split() for r in rows)]
    group = _groups(((i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])), len(rows))
    first = {}
    for r, g in zip(rows, group, strict=True):
        if g not in first or (r["doc_id"] is None, r["doc_id"] or 0) < (first[g]["doc_id"] is None, first[g]["doc_id"] or 0):
            first[g] = r
    return list(first.values())


def _unrepeated(rows):
    data = [(r["text"] or "").encode() for r in rows]
    seen = collections.Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    for r, b in zip(rows, data, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        yield {**r, "text": bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")}


def _mixed(rows):
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += size(r)
    names = [*sorted(s for s in sizes if s is not None), *([None] if None in sizes else [])]
    weight, share = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values())
    want, left, open_ = {}, share, set(names)
    while over := [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * sizes[s]]:
        want |= {s: 2.0 * sizes[s] for s in over}
        open_ -= set(over)
        left = share - sum(want.values())
    want |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    for r in rows:
        rate = want[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        name = str(r["doc_id"]) if r["doc_id"] is not None else "text:" + hashlib.md5((r["text"] or "").encode()).hexdigest()
        chance = int(hashlib.md5(f"7:{name}".encode()).hexdigest()[:12], 16) / (1 << 48)
        yield from [r] * (int(rate) + (chance < rate - int(rate)))


def test_pipeline_equals_brute_force(spark, docs, odd, library, sf_dir, tmp_path):
    """All stages at once on documents with copies, near copies, shared passages and odd rows, with a column of its own."""
    import corpus_pipeline

    some = docs.where(F.length("text") < 2500).limit(70).withColumns({"fp": F.lit("x"), "k1": F.lit(1)})
    near = some.limit(12).withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("text", F.concat("text", F.lit(" ending")))
    table = some.unionByName(near).unionByName(some.limit(5).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(odd.where("doc_id is null or doc_id <> 9").withColumn("doc_id", F.col("doc_id") + 20_000))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [r.asDict() for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    left = list(_mixed(list(_unrepeated(_one_of_each(_accepted(rows, labels))))))
    want = []
    for r in left:
        ids = library.encode_ordinary(r["text"])
        want.append((str(r["doc_id"]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert len(want) > 30 and sorted((str(r["doc_id"]), *list(r)[1:]) for r in got.collect()) == sorted(want)


def test_pipeline_stages_of_odd_and_empty_tables(spark, odd, none, sf_dir):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0, name
        if name != "bpe":
            assert stage(spark, odd, sf_dir).columns == odd.columns, name
