"""The llm operators against brute force, round trips and held-out accuracy, with edge cases."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
from pyspark.sql import functions as F

from skein.llm import jaccard_join, language_id, license_scan, mixing, packing, quality_rules, suffix_dedup, token_counts, vector_search
from skein.llm.chat_format import conversations
from skein.llm.shared import components, set_aside
from skein.llm.tokens import Words, at_spaces, encoded, ranks_path, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeéß中") for _ in range(r.randrange(1, 7))) for _ in range(300)]
    base = [" ".join(r.choice(vocabulary) for _ in range(80)) for _ in range(4)]
    out = []
    for i in range(150):
        words = (r.choice(base) if r.random() < 0.6 else " ".join(r.choice(vocabulary) for _ in range(r.randrange(90)))).split(" ")
        for _ in range(r.randrange(4)):
            words[r.randrange(len(words))] = f"z{r.randrange(99)}"
        out.append((i, " ".join(words)))
    out += [(200, None), (201, ""), (202, "x" * 900), (203, "ab" * 300), (204, "a\n\nb\na b c"), (3, out[3][1]), (4, "other " * 40), (None, out[0][1]), (205, "A B c"), (206, "a b C"), (207, "q " * 8000)]
    return out[::-1]


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup(spark, texts, hot):
    seen, want = set(), {}
    for i, b in sorted({(-(1 << 63) if i is None else i, (t or "").encode()) for i, t in texts}):
        gone = bytearray(len(b))
        for j in range(len(b) - 99):
            if (w := b[j : j + 100]) in seen:
                gone[j : j + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i, b] = (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest(), kept)
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(texts, DOCS).withColumn("n_bytes", F.lit("clash")).withColumn("x", F.lit(1)), hot=hot).collect()
    assert len(got) == len(texts)
    for g in got:
        assert want[-(1 << 63) if g.doc_id is None else g.doc_id, (g.text or "").encode()] == (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256, bytes(g.kept))


@pytest.mark.parametrize("length", [40, 400])
def test_suffix_dedup_lengths(spark, length):
    """Other lengths, also above 255 bytes; one text many times longer than a chunk; an empty table."""
    r = random.Random(21)
    passage = " ".join(r.choice("abcdefgh") * r.randrange(1, 9) for _ in range(220))
    rows = [(k, f"{k} {r.random()} " + passage[k : k + 600] + f" {r.random()}") for k in range(12)] + [(50, " ".join(str(r.random()) for _ in range(3000)) + passage)]
    seen, want = set(), {}
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if (w := b[j : j + length]) in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(w)
        want[i] = sum(gone)
    df = spark.createDataFrame(rows, DOCS)
    got = suffix_dedup.suffix_dedup(df, length=length, chunk_bytes=2_000).collect()
    assert {g.doc_id: g.n_removed for g in got} == want and sum(want.values()) > 1000
    assert suffix_dedup.suffix_dedup(df.limit(0), length=length).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.suffix_dedup(df, length=70_000)


def test_loser_tree_merges_front_coded_runs():
    r = random.Random(2)
    lists = [sorted((bytes(r.choice(b"ab") for _ in range(r.randrange(9))), b"l") for _ in range(r.randrange(30))) for _ in range(7)]
    out = list(suffix_dedup.merged([suffix_dedup.Run(*suffix_dedup.front_code(x)) for x in lists]))
    assert [o[2] for o in out] == sorted(x[0] for own in lists for x in own)
    for a, b in zip(out, out[1:]):
        assert b[4] == suffix_dedup.common(a[2], b[2], 0)


def brute_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= percent * len(sets[a] | sets[b]) or rows[a][0] == rows[b][0]:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), 1 << 62), i)
    return Counter((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("leaf,n,percent", [(2_000_000, 4, 85), (900, 4, 85), (2_000_000, 5, 80)])
def test_jaccard_components(spark, texts, leaf, n, percent):
    rows = [r for r in texts if r[0] is not None]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS), leaf_shingles=leaf, n=n, percent=percent).collect()
    assert Counter(map(tuple, got)) == brute_components(rows, n, percent)


@pytest.mark.parametrize("low", [5, -7])
def test_jaccard_copies_without_id(spark, low):
    """A copy without an id in the batch of its equals takes no link from them, whatever the ids' signs."""
    words = [f"w{k}" for k in range(120)]
    copy, near = " ".join(words), " ".join([*words[:-1], "other"])
    rows = [(None, copy), (low, copy), (9, near), (None, near), (None, "alone in the world here")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS).coalesce(1)).collect()
    assert Counter(map(tuple, got)) == Counter([(None, 117, low), (low, 117, low), (9, 117, low), (None, 117, low), (None, 2, None)])


def test_jaccard_edges(spark):
    clash = spark.createDataFrame([(1, "a b c d e"), (2, "A b C d e"), (3, None), (4, " ")], DOCS).withColumn("n", F.lit("x")).withColumn("component_id", F.lit(9)).withColumn("key", F.lit(0))
    got = jaccard_join.jaccard_components(clash).collect()
    assert Counter(map(tuple, got)) == Counter([(1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4)])
    assert jaccard_join.jaccard_components(clash.limit(0)).count() == 0
    long = " ".join(f"w{k}" for k in range(150_000))
    rows = [(5, long), (6, long + " tail"), (7, "x y z")]
    assert Counter(map(tuple, jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect())) == Counter([(5, 149_997, 5), (6, 149_998, 5), (7, 1, 7)])


@pytest.mark.parametrize("parts", [1, 5])
def test_one_of_each(spark, parts):
    words = [f"w{k}" for k in range(120)]
    a, near, far = " ".join(words), " ".join([*words[:-1], "other"]), " ".join(words[::-1])
    rows = [(1, a, 0), (1, far, 1), (2, near, 2), (None, near, 3), (None, "alone in a very new world", 4), (None, "alone in a very new world", 4), (3, None, 5), (3, None, 5), (4, None, 6), (5, far, 7), (6, "", 8), (7, near, 9), (7, a, 10), (8, "b " * 30, 11), (8, "c " * 30, 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int").withColumn("skein", F.lit(1))
    got = jaccard_join.one_of_each(df.repartition(parts, "extra"))
    assert got.columns == df.columns
    assert Counter(r.extra for r in got.collect()) == Counter([0, 1, 4, 5, 6, 8, 11, 12])
    single = df.where("extra IN (0, 2, 4, 6, 8, 11)").dropDuplicates(["extra"]).where("doc_id IS NOT NULL")
    assert Counter(r.extra for r in jaccard_join.one_of_each(single.repartition(parts)).collect()) == Counter([0, 6, 8, 11])
    assert jaccard_join.one_of_each(df.limit(0)).count() == 0


def test_jaccard_dense_keys(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FEW", 2)
    monkeypatch.setattr(jaccard_join, "MANY", 7)
    r = random.Random(1)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        w = base[:]
        for _ in range(r.randrange(6)):
            w[r.randrange(120)] = f"y{r.randrange(999)}"
        rows.append((i, " ".join(w)))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS), leaf_shingles=1500).collect()
    assert Counter(map(tuple, got)) == brute_components(rows, 4, 85)


def test_count_tree_loses_nothing():
    r = np.random.default_rng(3)
    points = r.poisson(6, (300, 16))
    points[150:] = np.maximum(points[:150] + r.integers(-1, 2, (150, 16)), 0)
    sizes = points.sum(axis=1)
    tree = jaccard_join.CountTree(points, sizes, fan=4)
    for q in range(300):
        o = np.minimum(points, points[q]).sum(axis=1)
        fits = (100 * o >= 85 * (sizes + sizes[q] - o)) & (sizes * 100 >= 85 * sizes[q]) & (sizes * 85 <= 100 * sizes[q])
        assert set(np.flatnonzero(fits)) <= set(tree.near(points[q], int(sizes[q]), 85).tolist())


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (5, 5), (7, 8)] + [(100 + i, 101 + i) for i in range(40)], "a long, b long")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 7: 7, 8: 7} | {100 + i: 100 for i in range(41)}


def test_mix_query_draws_blocks(spark, monkeypatch):
    from skein.llm import queries

    drawn, real = [], queries.mix_sources
    monkeypatch.setattr(queries, "mix_sources", lambda *a, **k: drawn.append(real(*a, **k)) or drawn[-1])
    got = queries.op2_mix_sources(spark, "/root/testdata/sf0.001").collect()
    want = {r.doc_id: r for r in drawn[0].collect()}
    assert all(b.shard >= 0 and b.place >= 0 for r in want.values() for b in r.blocks)
    assert {r.doc_id: r.taken for r in got} == {i: r.taken for i, r in want.items()} == {i: sum(b.words for b in r.blocks) for i, r in want.items()}


@pytest.mark.parametrize("notice,times", [("one two three four five", 6), ("one two three four five six", 5), ("one two three four", 7)])
def test_license_repeats_of_short_notices(spark, notice, times):
    rows = [(1, "\n".join([notice] * times)), (2, f"x {notice} y {notice}"), (3, notice)]
    got = license_scan.scan(spark.createDataFrame(rows, DOCS), templates={"t": notice}).collect()
    assert Counter(r.doc_id for r in got) == {1: times, 2: 2, 3: 1}
    assert all(r.passage == notice for r in got)


def test_mixing(spark):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.randrange(400)) if i % 9 else None, None if i % 10 == 3 else f"s{i % 10 % 4}") for i in range(120)] + [(7, "a b c", "s1"), (7, "a b c", "s1"), (300, "only few", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_sources(df, shard_words=5_000, block_words=32)
    got = mixed.collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([sizes[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))])))
    assert sum(goal.values()) == pytest.approx(sum(sizes.values()))
    taken = Counter()
    for g in got:
        assert g.size == len(WORD.findall(g.text or "")) and g.source_size == sizes[g.source] and g.target == pytest.approx(goal[g.source])
        assert g.taken == sum(b.words for b in g.blocks) <= 3 * g.size
        taken[g.source] += g.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in names)
    again = mixing.mix_sources(df.repartition(7), shard_words=5_000, block_words=32)
    assert Counter((g.doc_id, g.taken) for g in again.collect()) == Counter((g.doc_id, g.taken) for g in got)
    shards = Counter(b.shard for g in got for b in g.blocks)
    assert len(shards) == -(-round(sum(goal.values())) // 5_000)
    blocks = mixing.shuffled_blocks(mixed)
    assert blocks.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == sum(taken.values())
    passes = mixing.mixed_documents(mixed)
    assert passes.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == sum(taken.values())
    assert mixing.mix_sources(df.limit(0)).count() == 0


def plain_mix(rows, block, shards, seed, split):
    """Words that each (doc, text) gives, in plain Python over the same splitting function."""
    sources = {}
    for i, t, s in rows:
        sources.setdefault(s, []).append((i, len(WORD.findall(t or "")), t))
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for _, n, _ in sources[s]) for s in names]
    goal, left, active = [0.0] * len(names), sum(sizes), set(range(len(names)))
    while active:
        weight = sum((5, 2, 1)[k % 3] for k in active)
        over = {k for k in active if left * (5, 2, 1)[k % 3] > 3 * sizes[k] * weight}
        for k in over or active:
            goal[k] = 3 * sizes[k] if over else left * (5, 2, 1)[k % 3] / weight
        left -= sum(3 * sizes[k] for k in over)
        active = active - over if over else set()
    rest = [(min(round(g), 3 * n) % n if n else 0) for g, n in zip(goal, sizes)]
    drawn = [min(-(-r // block), n // block) for r, n in zip(rest, sizes)]
    runs = split(np.array(drawn), shards, seed)
    return names, sizes, goal, rest, drawn, runs


@pytest.mark.parametrize("shards", [1, 7])
def test_draws_follow_the_tree(shards):
    """Each shard draws what the tree gave it from its own run, blocks are disjoint, and other draws take other blocks."""
    for blocks, total in ((50, 20), (50, 50), (3, 1), (400, 0), (1, 1)):
        seen = []
        for seed in (1, 2, 3):
            own = mixing.split_quotas(np.array([total, 30]), shards, seed)[:, 0]
            shard, order = mixing.draws(np.arange(blocks), blocks, 9, np.cumsum(own))
            taken = order >= 0
            assert taken.sum() == total and sorted(order[taken]) == list(range(total))
            assert np.bincount(shard[taken], minlength=shards).tolist() == own.tolist()
            seen.append(taken.tolist())
        if shards > 1 and (blocks, total) == (50, 20):
            assert seen[0] != seen[1] or seen[1] != seen[2]


def test_mix_follows_the_tree(spark, monkeypatch):
    r = random.Random(14)
    rows = [(i, " ".join(["w"] * r.randrange(300)) if i % 9 else None, f"s{i % 5 % 4}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("clash")).withColumn("size", F.lit("clash")).withColumn("blocks", F.lit("clash"))
    real = mixing.split_quotas

    def swapped(quotas, shards, seed):
        return real(quotas, shards, seed)[::-1]

    outs = []
    for split in (real, swapped):
        monkeypatch.setattr(mixing, "split_quotas", split)
        got = mixing.mix_sources(df, block_words=32, shard_words=3_000).collect()
        names, sizes, goal, rest, drawn, runs = plain_mix(rows, 32, len({b.shard for g in got for b in g.blocks}), 20240601, split)
        last = Counter()
        for k, name in enumerate(names):
            own = [g for g in got if g.source == name]
            assert sum(g.taken for g in own) == round(goal[k]) and all(g.target == pytest.approx(goal[k]) and g.source_size == sizes[k] and g.taken <= 3 * g.size for g in own)
            whole = round(goal[k]) // sizes[k]
            assert sum(b.words for g in own for b in g.blocks if b["pass"] == whole) == rest[k]
            # words per shard of the last pass: as many blocks as the tree gave it, but for one that is cut
            for g in own:
                for b in g.blocks:
                    if b["pass"] == whole:
                        last[b.shard, k] += b.words
        for s in range(len(runs)):
            for k in range(len(names)):
                assert abs(last[s, k] - 32 * runs[s, k]) <= 32
        outs.append({g.doc_id: g.taken for g in got})
    assert outs[0] != outs[1]


def test_mixed_documents_part(spark):
    """Rows lie in the shards of their first blocks, and passes of one document do not stay side by side."""
    rows = [(i, " ".join(f"w{i}" for _ in range(50)), "a" if i % 10 else "b") for i in range(400)]
    mixed = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=16, shard_words=2_000)
    ids = [g.doc_id for g in mixing.mixed_documents(mixed).collect()]
    assert ids != sorted(ids) and sum(a == b for a, b in zip(ids, ids[1:])) < len(ids) / 10
    assert ids == [g.doc_id for g in mixing.mixed_documents(mixed).collect()]


def test_mix_of_very_long_text_and_no_rows(spark):
    rows = [(1, "word " * 200_000, "a"), (2, "", "b"), (3, None, None), (4, "x y", "b")]
    got = {g.doc_id: g for g in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].size == 200_000 and got[2].taken == got[3].taken == 0 and got[4].taken == 6 and got[1].taken == 199_996
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_permutation_and_quotas():
    for n in (1, 2, 3, 100, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 9).tolist()) == list(range(n))
    q = np.array([1000, 10, 0, 333])
    out = mixing.split_quotas(q, 7, 1)
    assert (out.sum(axis=0) == q).all() and np.ptp(out.sum(axis=1)) <= 7 and (out == mixing.split_quotas(q, 7, 1)).all()
    assert mixing.targets([10, 1000], [5, 2]) == [30.0, 980.0]


def test_license_edges(spark):
    full = (license_scan.templates_in(str(Path(license_scan.__file__).parent / "licenses")))
    assert {"MIT-full", "BSD-2-Clause", "Zlib"} <= set(full)
    mit = full["MIT-full"]
    rows = [(1, "Copyright x\n" + mit.replace("Software", "SOFTWARE")), (1, "Copyright x\n" + mit), (2, mit[: len(mit) // 2]), (3, "a\n" + full["Zlib"].replace("origin", "source") + "\n" + full["BSD-2-Clause"]), (None, mit), (4, "x " * 200_000 + mit)]
    df = spark.createDataFrame(rows, DOCS).withColumn("template", F.lit("clash")).withColumn("start", F.lit("clash"))
    got = license_scan.scan(df).collect()
    assert Counter((g.doc_id, g.template) for g in got if g.template in full) == Counter([(1, "MIT-full"), (1, "MIT-full"), (3, "Zlib"), (3, "BSD-2-Clause"), (None, "MIT-full"), (4, "MIT-full")])
    assert [(g.doc_id, g.template) for g in got if g.template not in full] == [(2, "MIT-permission")]
    assert license_scan.scan(df.limit(0)).count() == 0
    ties = {"first": "alpha beta gamma delta epsilon", "second": "alpha beta gamma delta epsilon"}
    assert [g.template for g in license_scan.scan(spark.createDataFrame([(1, "x alpha beta gamma delta epsilon y")], DOCS), templates=ties).collect()] == ["first"]
    with pytest.raises(ValueError, match="needs 3 words"):
        license_scan.scan(df, templates={"short": "two words"})


def test_license_bound_holds_back_no_match():
    rng = np.random.default_rng(8)
    for _ in range(300):
        template = rng.integers(0, 9, rng.integers(5, 60))
        text = rng.integers(-1, 9, rng.integers(0, 150))
        at, step = int(rng.integers(-20, 140)), int(rng.integers(2, 9))
        if at >= 0:
            copy = np.delete(template, np.arange(step, len(template), step))[: max(len(text) - at, 0)]
            text[at : at + len(copy)] = copy
        band = int(rng.integers(0, 8))
        assert license_scan.possible(template, text, at, band) >= license_scan.aligned(template, text, at, band)[0]


def test_license_full_texts(spark):
    """Long licenses, changed in places, are found whole; scattered phrases of one are told apart quickly."""
    full = license_scan.templates_in(str(Path(license_scan.__file__).parent / "licenses"))
    rng = np.random.default_rng(9)
    rows, want = [], []
    for i, name in enumerate(sorted(full)):
        text = full[name].split()
        for j in range(7, len(text), 23):
            text[j] = "changed"
        rows.append((i, "before it\n" + " ".join(text) + "\nafter it"))
        want.append((i, name))
    gpl = full["GPL-3.0-full"].split()
    phrases = [" ".join(gpl[a : a + 6] + ["xyz"] * 2) for a in rng.integers(0, len(gpl) - 6, 2500)]
    rows.append((100, " ".join(phrases)))
    df = spark.createDataFrame(rows, DOCS)
    started = time.monotonic()
    got = license_scan.scan(df.where("doc_id = 100")).collect()
    assert not [g for g in got if g.template == "GPL-3.0-full"] and time.monotonic() - started < 10  # an alignment for every hit takes far longer
    got = license_scan.scan(df.where("doc_id < 100")).collect()
    assert sorted((g.doc_id, g.template) for g in got if g.template in full) == want


def plain_alignment(template, text):
    """Best local alignment of two word lists without band: score by 2 for a match and -1 for a replaced, missing or extra word."""
    best, before = (0, 0), [(0, 0)] * (len(text) + 1)
    for word in template:
        row = [(0, 0)]
        for j, other in enumerate(text, 1):
            top = max((before[j - 1][0] + (2 if word == other else -1), before[j - 1][1] + (word == other)), (before[j][0] - 1, before[j][1]), (row[j - 1][0] - 1, row[j - 1][1]))
            row.append(top if top[0] > 0 else (0, 0))
            best = max(best, row[-1])
        before = row
    return best[1]


def test_license_scan_against_plain_alignment(spark):
    """Templates with words replaced, dropped or added: those that a full alignment covers are found, with its coverage."""
    r = random.Random(17)
    split = lambda t: [w.lower() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t)]
    names = ["MIT-permission", "Apache-2.0-header", "GPL-3.0-notice", "BSD", "ISC"]
    rows = []
    for i in range(60):
        words = split(license_scan.TEMPLATES[names[i % 5]])
        for _ in range(r.randrange(4)):
            at = r.randrange(len(words))
            words[at : at + r.randrange(2)] = ["changed"] * r.randrange(2)
        rows.append((i, "before this " + " ".join(words) + " after that"))
    only = {n: license_scan.TEMPLATES[n] for n in names}
    got = {g.doc_id: (g.template, g.matched) for g in license_scan.scan(spark.createDataFrame(rows, DOCS), templates=only).collect()}
    for i, text in rows:
        name = names[i % 5]
        matched = plain_alignment(split(only[name]), split(text))
        assert got.get(i) == ((name, matched) if matched >= 0.8 * len(split(only[name])) else None)


def test_license_scan(spark):
    permission = license_scan.TEMPLATES["MIT-permission"]
    changed = permission.replace("free of charge", "at no charge").upper()
    rows = [(1, "é text\nReleased under the MIT License.\nmore"), (2, changed), (3, None), (4, ""), (5, "Licensed under the sea. Apache helicopters"), (6, "Licensed under CC BY-NC 4.0.  and Licensed under CC BY-NC 4.0."), (6, "x " * 3000 + "This work is licensed under the GNU General Public License, version 3.")]
    got = license_scan.scan(spark.createDataFrame(rows, DOCS).select("text", F.lit(1).alias("start"), "doc_id")).collect()
    assert sorted((g.doc_id, g.template) for g in got) == [(1, "MIT"), (2, "MIT-permission"), (6, "CC-BY-NC-4.0"), (6, "CC-BY-NC-4.0"), (6, "GPL-3.0")]
    for g in got:
        source = next(t for i, t in rows if i == g.doc_id and t and g.passage in t)
        assert source.encode()[g.start : g.end].decode() == g.passage and (g.coverage == 1.0 or g.doc_id == 2)


def brute_conversation(rows):
    """(reply_to, n_linked) by (conv, turn), said in plain Python."""
    level = lambda x: len(re.sub("[^>]", "", (re.match(r"[ \t]*(?:>[ \t]*)+", x) or [""])[0]))
    norm = lambda x: re.sub(r"\s+", " ", x).strip(" ").lower()
    runs = {}
    for c, t, _, text in rows:
        own = runs.setdefault((c, t), [])
        fresh = True
        for line in (text or "").split("\n"):
            lv, body = level(line), re.sub(r"^[ \t]*(?:>[ \t]*)+", "", line)
            if not fresh and own[-1][0] == lv:
                own[-1][1].append(body)
            else:
                own.append((lv, [body]))
            fresh = False
    says = {k: {norm(u) for lv, bodies in own if not lv for u in ["\n".join(bodies), *bodies]} for k, own in runs.items()}
    out = {}
    for (c, t), own in runs.items():
        votes = Counter()
        for lv, bodies in own:
            whole = norm("\n".join(bodies))
            found = lambda u: [s for (d, s), v in says.items() if d == c and s < t and u and u in v]  # noqa: B023, E731
            if lv:
                for u in [whole] if found(whole) else map(norm, bodies):
                    if found(u):
                        votes[max(found(u))] += len(u)
        back = t - 1 if any((c, t - 1) == (d, s) for d, s, *_ in rows) else None
        out[c, t] = (max(votes, key=lambda s: (votes[s], s)) if votes else back, sum(votes.values()))
    return out


CHAT = "conv_id long, turn int, role string, text string"


def talk():
    r = random.Random(8)
    said = [f"line number {k} of talk" for k in range(30)]
    rows = []
    for c in range(12):
        for t in range(r.randrange(1, 30)):
            own = [r.choice(said) for _ in range(r.randrange(3))]
            quotes = [">" * r.randrange(1, 3) + " " + r.choice(said).upper() for _ in range(r.randrange(3))]
            rows.append((c, t, "user", "\n".join(quotes + own)))
    long = [(60, t, "user", f"common line\nown {t}" if t % 700 else "> common line\n> nobody said this") for t in range(2500)]
    return rows + [(50, 9, None, None), (61, 0, "a", "one two\nthree four"), (61, 1, "b", "On Monday a wrote:\n> One  two\n> three FOUR\nyes"), (61, 3, "b", "> three four\n> other\nno")] + long


def test_conversations(spark):
    rows = talk()
    got = conversations(spark.createDataFrame(rows, CHAT).withColumn("root", F.lit("clash")).withColumn("part", F.lit("clash"))).collect()
    want = brute_conversation([x for x in rows if x[0] != 60])
    assert len(got) == len(rows) and {(g.conv_id, g.turn): (g.reply_to, g.n_linked) for g in got if g.conv_id != 60} == want
    for g in got:
        if g.conv_id == 60:  # the last earlier turn that says the line, across stretches of turns
            assert (g.reply_to, g.n_linked) == ((g.turn - 1 if g.turn else None), 11 if g.turn and not g.turn % 700 else 0)
            continue
        at = g.turn
        while want[g.conv_id, at][0] is not None:
            at = want[g.conv_id, at][0]
        assert g.root == at and ">" not in g.text
    assert [(g.conv_id, g.root, g.turn) for g in got] == sorted((g.conv_id, g.root, g.turn) for g in got)
    one = {(g.conv_id, g.turn): g for g in got}
    assert (one[61, 1].n_linked, one[61, 1].n_quoted, one[61, 1].text, one[61, 1].formatted) == (18, 2, "yes", "<|b|>\nyes<|end|>\n")
    assert (one[61, 3].reply_to, one[61, 3].n_linked) == (0, 10)
    plan = conversations(spark.createDataFrame(rows, CHAT))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_conversations_twin_on_quotes(spark, tmp_path):
    """The SQL twin on conversations that do quote."""
    duckdb = pytest.importorskip("duckdb")
    from skein.llm.queries import SQL, op5_chat_format

    spark.createDataFrame(talk(), CHAT).write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    twin = duck.sql(SQL["op5_chat_format"])
    got = op5_chat_format(spark, str(tmp_path)).select(*twin.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, twin.fetchall()))


def test_conversations_edges(spark):
    rows = [(None, 1, "u", "> a"), (1, None, "u", "a"), (1, 2, "u", "hello"), (1, 2, "v", "> x\nthere"), (1, 2, "v", "> x\nthere"), (1, 5, "u", "> HELLO\n> there\nok"), (2, 0, "u", "")]
    got = conversations(spark.createDataFrame(rows, CHAT)).collect()
    assert len(got) == len(rows)
    assert {(g.conv_id, g.turn): (g.reply_to, g.root) for g in got} == {(None, 1): (None, 1), (1, None): (None, None), (1, 2): (None, 2), (1, 5): (2, 2), (2, 0): (None, 0)}
    assert [g.n_linked for g in got if g.turn == 5] == [10]
    assert conversations(spark.createDataFrame([], CHAT)).count() == 0
    long = [(1, 0, "u", "word " * 100_000), (1, 1, "u", "> " + "word " * 100_000)]
    assert [g.n_linked for g in conversations(spark.createDataFrame(long, CHAT)).collect()] == [0, 499_999]


def plain_packing(lengths, size, open_most, least):
    """Windows of (document, start, length), by the docstring's rules, with a list that is searched from end to end."""
    done, held = [], []
    for doc, total in enumerate(lengths):
        at = 0
        while total - at >= size:
            done.append([(doc, at, size)])
            at += size
        while at < total:
            rest = total - at
            fits = [w for w in held if size - sum(p[2] for p in w) >= rest]
            if fits:
                window = min(fits, key=lambda w: size - sum(p[2] for p in w))
            elif len(held) < open_most:
                window = []
                held.append(window)
            else:
                window = max(held, key=lambda w: sum(p[2] for p in w))
                held = [w for w in held if w is not window]
                room = size - sum(p[2] for p in window)
                if room >= least:
                    window.append((doc, at, room))
                    at += room
                done.append(window)
                continue
            window.append((doc, at, rest))
            at = total
            if sum(p[2] for p in window) == size:
                done.append(window)
                held = [w for w in held if w is not window]
    return done, sum(p[2] for w in held for p in w)


@pytest.mark.parametrize("open_most,least", [(1, 1), (3, 4), (8, 16), (64, 16)])
def test_packing_against_plain_version(open_most, least):
    """Full and emitted windows hold as much as those of a plain packer, in the same order; leftovers fill windows or powers of two."""
    r = random.Random(13)
    lengths = [r.choice([1, 2, 5, 17, 40, 63, 64, 65, 200]) + r.randrange(20) for _ in range(700)]
    packer = packing.Packer(64, open_most, least, 0)
    for doc, n in enumerate(lengths):
        packer.place(doc, np.arange(n, dtype="<u4"))
    before = packer.next_id
    packer.finish()
    got = {}
    for doc, start, length, total, sequence, offset, ids in packer.out:
        assert total == lengths[doc] and np.frombuffer(ids, "<u4").tolist() == list(range(start, start + length))
        assert offset == sum(p[2] for p in got.setdefault(sequence, []))
        got[sequence].append((doc, start, length))
    want, left = plain_packing(lengths, 64, open_most, least)
    assert [sum(p[2] for p in got[k]) for k in range(before)] == [sum(p[2] for p in w) for w in want]
    rest = [sum(p[2] for p in got[k]) for k in sorted(got) if k >= before]
    assert sum(rest) == left and all(n & (n - 1) == 0 for n in rest) and rest[: left // 64] == [64] * (left // 64)
    pieces = sorted(p for w in got.values() for p in w)
    assert all(sum(p[2] for p in pieces if p[0] == doc) == lengths[doc] for doc in range(0, 700, 50))
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(pieces, pieces[1:]))


def test_packing_edges(spark):
    rows = [(1, "same words here"), (1, "same words here"), (None, "no id"), (2, None), (3, ""), (4, "word " * 300_000)]
    df = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit("clash")).withColumn("offset", F.lit("clash")).coalesce(1)
    got = packing.pack(df).collect()
    assert Counter(g.doc_id for g in got if g.start == 0) == Counter([1, 1, None, 2, 3, 4])
    assert {g.doc_tokens for g in got if g.doc_id in (2, 3)} == {1} and sum(g.length for g in got if g.doc_id == 4) == 300_002
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(df, size=100)


def test_packing_round_trip(spark, texts):
    df = spark.createDataFrame(texts, DOCS).repartition(3)
    got = packing.pack(df, open_most=3).collect()
    sequences, docs = {}, {}
    for g in got:
        assert len(g.ids) == 4 * g.length
        sequences.setdefault(g.sequence_id, []).append(g)
        docs.setdefault(g.doc_id, []).append(g)
    padding = 0
    for parts in sequences.values():
        at = 0
        for g in sorted(parts, key=lambda g: g.offset):
            assert g.offset == at
            at += g.length
        assert 0 < at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 16 * len(sequences)
    lone = Counter(i for i, _ in texts)
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        if lone[i] == 1:
            parts = sorted(docs[i], key=lambda g: g.start)
            joined = b"".join(bytes(g.ids) for g in parts)
            assert joined == np.append(ids, 1).astype("<u4").tobytes() and all(g.doc_tokens == len(ids) + 1 for g in parts)
    assert packing.pack(df.limit(0)).count() == 0
    assert zlib.crc32(bytes(got[0].ids)) == packing.pack(df, open_most=3).where((F.col("sequence_id") == got[0].sequence_id) & (F.col("offset") == got[0].offset)).select(F.crc32("ids")).first()[0]


def ids_of(own, samples):
    ids, offsets = own(pa.array(samples, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def test_tokens_of_both_files():
    other = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(6)
    samples = ["", "a  b\n\n c\t", "it's <|endoftext|> here", "日本 é ½ ²", " 　x"] + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 1500), r.randrange(0x3000, 0xD7FF), 10, 32])) for _ in range(60)) for _ in range(200)]
    for path in (tokenizer_path(), ranks_path()):
        assert ids_of(lambda x: encoded(x, path), samples) == [other.encode(x, add_special_tokens=False).ids for x in samples]  # noqa: B023
        assert ids_of(lambda x: encoded(x, path), [None, "a", None]) == [[], other.encode("a").ids, []]  # noqa: B023
        assert ids_of(lambda x: encoded(x, path), []) == []  # noqa: B023


@pytest.mark.parametrize("kind", ["plain", "forgets", "collides", "cuts"])
def test_words_are_encoded_independently(kind, monkeypatch):
    path = tokenizer_path()
    other = tokenizers.Tokenizer.from_file(path)
    own = Words(path, **{"forgets": {"most": 300, "slots": 16}, "cuts": {"chunk": 40}}.get(kind, {}))
    if kind == "collides":
        monkeypatch.setattr("skein.llm.tokens.spans_hash", lambda prefix, starts, ends: prefix[starts] * 0 + np.uint64(7) + (ends - starts > 3))

    def check(samples):
        assert ids_of(own.ids, samples) == [x.ids for x in other.encode_batch(samples, add_special_tokens=False)]

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    points = points[:0x3200:17] if kind == "collides" else points[:0x10000:3] + points[0x10000:0x20000:7] + points[0x20000::977]
    check(["".join("a{0}a1{0}1!{0}! {0}  {0}  '{0}'s{0}".format(chr(c)) for c in points[k : k + 10]) for k in range(0, len(points), 10)])
    r = random.Random(7)
    check(["".join(r.choice(["'", "s", "ll", "Re", " ", "  ", "\n", "7", "\xa0", "é", *map(chr, range(128))]) for _ in range(50)) for _ in range(100 if kind == "collides" else 3000)])
    check(["", "a\u0558b \u0c5c's \U0001f600", "it's <|endoftext|> here", "x" * 500 + " 12\u00b2 " * 40, "", "<|endoftext|><|endoftext|>", "a <|endo", "ftext|> b", "'", "'s", "'r", "e", " "])
    check(["some words that go on and on, it's " * 30 + "中文" * 60 + " and <|endoftext|> more words " * 9, "中" * 200])
    path = public_tokenizers.path("word_bpe_49k.json")
    assert ids_of(Words(path).ids, ["Some WORDS  here", None]) == [tokenizers.Tokenizer.from_file(path).encode("Some WORDS  here", add_special_tokens=False).ids, []]


def test_texts_are_cut_where_words_end():
    text = ("one two, three  four\nfive six 7 eight" * 50).encode()
    parts = list(at_spaces(np.frombuffer(text, np.uint8), 100))
    assert b"".join(x.tobytes() for x in parts) == text and len(parts) > 10
    assert [x.tobytes() for x in at_spaces(np.frombuffer(b"x" * 1000, np.uint8), 100)] == [b"x" * 1000]


def test_token_counts(spark, texts):
    other = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = [len(other.encode(t or "", add_special_tokens=False).ids) for _, t in texts]
    got = token_counts.context_limits(token_counts.length_histogram(spark.createDataFrame(texts, DOCS))).collect()
    assert {g.n_tokens: g.n_docs for g in got} == Counter(lengths)
    for g in got:
        assert g.truncated_tokens == sum(min(n, g.n_tokens) for n in lengths) and g.docs_at_least == sum(n >= g.n_tokens for n in lengths)
        assert g.quantile == pytest.approx(sum(n <= g.n_tokens for n in lengths) / len(lengths))


def test_token_counts_edges(spark):
    rows = [("a", None), ("a", ""), ("b", "one two"), ("b", "one two"), (None, "word " * 100_000)]
    df = spark.createDataFrame(rows, "g string, text string").withColumn("n_tokens", F.lit("clash"))
    got = token_counts.context_limits(token_counts.length_histogram(df, ["g"]), ["g"]).collect()
    assert {(g.g, g.n_tokens): (g.n_docs, g.total_docs, g.quantile) for g in got} == {("a", 0): (2, 2, 1.0), ("b", 2): (2, 2, 1.0), (None, 100_001): (1, 1, 1.0)}
    assert token_counts.context_limits(token_counts.length_histogram(df.limit(0))).count() == 0
    assert token_counts.encoded_lengths(df).dtypes == [("g", "string"), ("text", "string"), ("n_tokens", "bigint")]


def plain_statistics(t):
    t = t or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c, marked = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked)


def test_quality_rules(spark, texts):
    r = random.Random(9)
    extra = [(1000 + i, " ".join(f"w{r.randrange(9999)}" + ("###" if i % 5 == 0 else "") for _ in range(60))) for i in range(4000)]
    lines = [(900, "a\n\n a\na\n\na b|\n"), (901, "\n\n"), (902, "x\ny\nx\n")]
    docs = spark.createDataFrame(texts + extra + lines, DOCS).withColumn("lang", F.lit("xx")).withColumn("n_words", F.lit("clash"))
    labels = spark.createDataFrame([(1000 + i, int(i % 5 != 0) if i % 97 else None) for i in range(4000)], "doc_id long, quality int")
    got = quality_rules.quality_verdicts(docs, labels).collect()
    want = {(i if i is not None else -1): [] for i, _ in texts + extra + lines}
    for i, t in texts + extra + lines:
        want[-1 if i is None else i].append(plain_statistics(t))
    for g in got:
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) in want[-1 if g.doc_id is None else g.doc_id]
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words)
    kept = {g.doc_id: g.kept for g in got}
    assert all(kept[1000 + i] == (i % 5 != 0) for i in range(4000))
    assert quality_rules.kept_documents(docs.drop("n_words"), labels).count() == sum(g.kept for g in got)
    none = quality_rules.quality_verdicts(docs.limit(0), labels.limit(0))
    assert none.count() == 0


def test_quality_strata_and_ties(spark):
    """A null stratum and several strata are judged apart; a value equal to the cutoff stays; repeated ids are judged each."""
    plain = " ".join(f"w{k}" for k in range(60))
    noisy = plain + " " + "#" * 200
    rows = [(i, "xx" if i % 2 else None, noisy if i % 5 == 0 else plain) for i in range(6000)] + [(7000, "yy", noisy), (7000, "yy", plain), (7001, None, noisy), (7002, "xx", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("kept", F.lit("clash")).withColumn("base_failed", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 5 != 0), "x") for i in range(6000)] + [(1, None, "x"), (None, 0, "x")], "doc_id long, quality int, lang string")
    got = quality_rules.quality_verdicts(docs, labels).collect()
    kept = {(g.doc_id, g.n_symbols > 0): g.kept for g in got}
    assert len(got) == len(rows) and kept[7000, True] and kept[7000, False] and not kept[7001, True] and not kept[7002, False]
    assert all(kept[i, i % 5 == 0] == (i % 5 != 0) for i in range(6000))
    measured = quality_rules.with_statistics(docs.select("doc_id", "lang", "text"))
    chosen = quality_rules.cutoffs(measured, labels)
    assert {c[0] for c in chosen} == {None, "xx"}
    edge = spark.createDataFrame([(1, "xx", c) for s, r, c, *_ in chosen if s == "xx" and r == "symbols"], "doc_id long, lang string, at double")
    tie = edge.select("lang", F.lit(10_000_000_000_000).alias("n_words"), (F.col("at") * 10_000_000_000_000).cast("long").alias("n_symbols"), *[F.lit(0).cast("long").alias(c) for c in ("word_chars", "n_dup_lines", "n_repeat_words", "n_lines")])
    assert quality_rules.judged(tie.withColumn("word_chars", F.col("n_words") * 3), [c for c in chosen if c[1] == "symbols"]).first().kept
    shown = quality_rules.report(chosen, 2)
    assert all(x["at_most_lost"] <= 0.05 / len(quality_rules.RULES) and x["lost"] == 0 and x["caught"] > 0 for x in shown)


def test_quality_risk_is_controlled():
    """Over many draws of labels, a cutoff that loses more than alpha / rules of good documents is certified in at most delta of them."""
    rng = np.random.default_rng(12)
    share = np.concatenate(([0.0] * 40, np.full(24, 0.004)))  # of good documents, in each cell of the grid of `symbols`
    loses = np.cumsum(share)
    grid = quality_rules.RULES["symbols"][3]
    wrong = 0
    for _ in range(300):
        good = rng.multinomial(3000, [*share, 1 - share.sum()])
        cells = [("a", "symbols", k, int(g), 50 if k == 60 else 0) for k, g in enumerate(good)]
        for *_, cutoff, _, _, _ in quality_rules.certified_cutoffs(cells, 0.05, 0.05, 0.0):
            wrong += loses[grid.index(cutoff)] > 0.01
    assert wrong <= 300 * 0.05


def test_binomial_bound_and_control():
    from math import comb

    assert quality_rules.binomial_at_most(3, 50, 0.1) == pytest.approx(sum(comb(50, k) * 0.1**k * 0.9 ** (50 - k) for k in range(4)))
    cells = [("a", "symbols", 64, 990, 0), ("a", "symbols", 0, 0, 50), ("b", "symbols", 0, 0, 50), ("b", "symbols", 64, 20, 0)]
    assert {c[0] for c in quality_rules.certified_cutoffs(cells, 0.05, 0.05, 10)} == {"a"}
    lossy = [("a", "symbols", 64, 500, 0), ("a", "symbols", 0, 500, 900)]
    assert not quality_rules.certified_cutoffs(lossy, 0.05, 0.05, 10)


def test_language_id(spark):
    r = random.Random(11)
    parts = {"aa": ["tion", "the", "ing", "er"], "bb": ["ung", "sch", "ein", "ö"], "cc": ["eau", "qué", "le", "ment"]}
    rows = [(i, lang, "".join(r.choice(parts[lang]) + (" " if r.random() < 0.4 else "") for _ in range(r.randrange(10, 60)))) for i in range(600) for lang in [r.choice(list(parts))]]
    df = spark.createDataFrame(rows + [(900, None, "123 456"), (901, "aa", None), (902, "bb", ""), (903, None, "ж" * 50)], "doc_id long, lang string, text string")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    models, limits = language_id.train(df.where(~held), per_language=100)
    got = {g.doc_id: g for g in language_id.identify(df, models, limits).collect()}
    assert np.mean([got[i].lang_pred == lang for i, lang, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]) > 0.99
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].rejected and got[903].lang_pred != "und"
    assert all(0 <= g.score <= 1 for g in got.values())
    p = np.exp(-models.entropies(["tionthe"])[0])
    assert p.shape == (1, 3) and (p > 0).all() and (p <= 1).all()


def test_models_against_plain_kneser_ney():
    """Probabilities of a plain version: raw counts at the top, continuation counts below, one discount an order."""
    training = ["abab abba bab cab", "aab bcb", "cc ab abcab bca", "abc abd bad"]
    models = language_id.Models({"aa": training})
    order = language_id.ORDER
    raw = [Counter() for _ in range(order)]
    for t in training:
        padded = " " * (order - 1) + t
        for i in range(len(t)):
            for k in range(order):
                raw[k][padded[i + order - 1 - k : i + order], (k > 0 and i == 0)] += 1
    merged = [Counter() for _ in range(order)]
    contexts = [{} for _ in range(order)]
    for k in range(order):
        for (g, first), n in raw[k].items():
            merged[k][g] += n
            contexts[k].setdefault(g, ("start",) if first else (g[:-1],))
    counts = [merged[-1] if k == order - 1 else Counter(g[1:] for g in merged[k + 1]) for k in range(order)]
    tables = []
    for k in range(order):
        one, two = sum(n == 1 for n in counts[k].values()), sum(n == 2 for n in counts[k].values())
        d = one / (one + 2 * two) if one and two else 0.5
        total, kinds = Counter(), Counter()
        for g, n in counts[k].items():
            total[contexts[k][g]] += n
            kinds[contexts[k][g]] += 1
        tables.append((d, total, kinds))
    letters = set("".join(training))

    def probability(text, i):
        p = 1 / (len(letters) + 1)
        padded = " " * (order - 1) + text
        for k in range(order):
            g = padded[i + order - 1 - k : i + order]
            c = ("start",) if k and i == 0 else (g[:-1],)
            d, total, kinds = tables[k]
            own = (counts[k][g] - d) / total[contexts[k][g]] if counts[k][g] else 0.0
            p = own + (d * kinds[c] / total[c] if total[c] else 1.0) * p
        return p

    for text in ("abba", "cab bad", "zab", "a", "bcb abx cc", "ab" * 20):
        got, n = models.entropies([text])
        assert got[0, 0] == pytest.approx(-np.mean([np.log(probability(text, i)) for i in range(len(text))]), rel=1e-4)
        assert n[0] == len(text.replace(" ", ""))


def test_language_edges(spark):
    training = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate([("aa", "hello there friend"), ("bb", "bonjour mon ami")] * 20)] + [(500, None, "no language"), (501, "cc", None)], "doc_id long, lang string, text string")
    models, limits = language_id.train(training)
    rows = [(1, "hello"), (1, "bonjour"), (2, "\u0301\u0302 12"), (None, "hello"), (3, "hello " * 50_000), (4, "\u4e2d")]
    df = spark.createDataFrame(rows, DOCS).withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit("clash"))
    got = language_id.identify(df, models, limits).collect()
    assert Counter((g.doc_id, g.lang_pred) for g in got if g.doc_id != 4) == Counter([(1, "aa"), (1, "bb"), (2, "und"), (None, "aa"), (3, "aa")])
    assert next(g.score for g in got if g.doc_id == 2) == 0 and next(g.lang_pred for g in got if g.doc_id == 4) in ("aa", "bb")
    assert language_id.identify(df.limit(0), models, limits).count() == 0
    none, no_limits = language_id.train(training.limit(0))
    assert {g.lang_pred for g in language_id.identify(df, none, no_limits).collect()} == {"und"}
    twins, limits = language_id.train(spark.createDataFrame([(i, "ba"[i % 2], "same text here") for i in range(40)], "doc_id long, lang string, text string"))
    assert language_id.identify(spark.createDataFrame([(1, "same text")], DOCS), twins, limits).first().lang_pred == "a"


def test_sampled_is_the_least_hash(spark):
    rows = [(i, f"l{i % 3}", "t") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("h", F.xxhash64("doc_id"))
    got = language_id.sampled(df.repartition(13), "doc_id", "text", "lang", 50).groupBy("lang").agg(F.count("*").alias("n"), F.count_if("calibrate").alias("c")).collect()
    assert {g.lang: (g.n, g.c) for g in got} == {f"l{k}": (50, 10) for k in range(3)}


def test_models_are_distributions():
    models = language_id.Models({"aa": ["abab abba bab", "aab"]})
    for context in ("ab", "b", "abb", "zz"):  # all letters seen, the space and one that stands for the unseen
        before, _ = models.entropies([context])
        total = 0.0
        for x in ("a", "b", " ", "c"):
            after, _ = models.entropies([context + x])
            total += float(np.exp(-(after[0, 0] * (len(context) + 1) - before[0, 0] * len(context))))
        assert total == pytest.approx(1, abs=1e-4)


def plain_nearest(rows, wanted, k):
    """(query id, place) to (vec_id, score) lists, by all inner products; place tells rows of one id apart."""
    good = [(i, x, u) for x, (i, u) in enumerate(rows) if i is not None and u is not None and len(u) == 16 and all(c is not None and np.isfinite(c) for c in u) and any(u)]
    v = np.array([u for *_, u in good])
    out = []
    for a, (i, x, u) in enumerate(good):
        if wanted(i):
            s = np.einsum("ij,ij->i", v, np.broadcast_to(v[a], v.shape))
            out.append((i, sorted(((-s[b], j) for b, (j, *_) in enumerate(good) if b != a))[:k]))
    return out


@pytest.mark.parametrize("kind", ["even", "clusters", "copies"])
def test_vector_search(spark, kind):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((700, 16)).astype(np.float32).astype(float)
    if kind == "clusters":
        v = (np.repeat(rng.standard_normal((10, 16)) * 5, 70, axis=0) + 0.1 * v).astype(np.float32).astype(float)
    if kind == "copies":
        v[:300] = v[0]
        v[300:600] = v[300] + rng.integers(0, 2, (300, 16)) * 1e-4
    v[5], v[6] = v[4], 0
    rows = [(i, [float(x) for x in u]) for i, u in enumerate(v)] + [(1000, None), (1001, [1.0, None] + [0.0] * 14), (1002, [float("nan")] * 16), (1020, [1.0, 2.0]), (1040, [float("inf")] * 16), (None, [1.0] * 16)]
    rows += [rows[20], rows[20], (40, rows[41][1])]  # repeated rows, an id with two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = plain_nearest(rows, lambda i: i % 20 == 0, 7)
    for data in (df, df.select(F.col("embedding").cast("array<float>"), F.lit("clash").alias("row"), F.lit(1).alias("score"), "vec_id")):
        got = vector_search.nearest(data, F.col("id") % 20 == 0, k=7, part=256, reach=700)
        found = {}
        for g in got.orderBy("query_id", "rank").collect():
            found.setdefault(g.query_id, []).append((g.rank, g.vec_id, g.score))
        assert sorted(found) == sorted({i for i, _ in want})
        for i, own in found.items():
            expected = sorted(x for j, x in want if j == i)
            own = sorted([(-s, j) for r, j, s in own if r > 0]) if len(expected) > 1 else [(-s, j) for _, j, s in own]
            flat = sorted(y for x in expected for y in x) if len(expected) > 1 else expected[0]
            assert [x[0] for x in own] == pytest.approx([x[0] for x in flat], abs=1e-4 if data is not df else 1e-9)
            if data is df and kind != "copies":
                assert [x[1] for x in own] == [x[1] for x in flat]
            if data is df and kind == "copies" and i < 300:
                assert [x[1] for x in own] == [x[1] for x in flat]  # ties among 300 equal vectors
    few = vector_search.nearest(df.limit(3), F.col("id") == 0, k=7).collect()
    assert sorted(g.vec_id for g in few) == [1, 2]
    assert vector_search.nearest(df.limit(0), F.col("id") == 0).count() == 0
    assert vector_search.nearest(df.where("vec_id >= 1000"), F.col("id") == 1020).count() == 0


@pytest.mark.parametrize("kind", ["even", "clusters"])
def test_vector_search_recall(spark, kind):
    """What the curves alone find, with windows far smaller than the table."""
    rng = np.random.default_rng(5)
    v = rng.standard_normal((6000, 24))
    if kind == "clusters":
        v = np.repeat(rng.standard_normal((60, 24)), 100, axis=0) + 0.3 * v
    df = spark.createDataFrame([(i, [float(x) for x in u]) for i, u in enumerate(v)], "vec_id long, embedding array<float>")
    got = vector_search.nearest(df, F.col("id") % 20 == 0, k=10, part=1500, reach=500).collect()
    exact = {q: set(np.argsort(-np.where(np.arange(6000) == q, -np.inf, v @ v[q]))[:10].tolist()) for q in range(0, 6000, 20)}
    assert sum(g.vec_id in exact[g.query_id] for g in got) / 3000 >= 0.9


@pytest.mark.parametrize("kind,most", [("even", 2500), ("clusters", 300)])
@pytest.mark.parametrize("sample", [500_000, 3000])
def test_vector_search_fits_its_reach(spark, monkeypatch, kind, most, sample):
    """The curves carry the recall: windows are as wide as the vectors ask for, whether the sample is whole or a part."""
    rng = np.random.default_rng(6)
    v = rng.standard_normal((6000, 24))
    if kind == "clusters":
        v = np.repeat(rng.standard_normal((120, 24)), 50, axis=0) + 0.3 * v
    df = spark.createDataFrame([(i, [float(x) for x in u]) for i, u in enumerate(v)], "vec_id long, embedding array<float>")
    reaches, plain = [], vector_search.least_reach
    monkeypatch.setattr(vector_search, "least_reach", lambda *x: reaches.append(plain(*x)[0]) or plain(*x))
    got = vector_search.nearest(df, F.col("id") % 20 == 0, k=10, part=512, sample=sample).collect()
    exact = {q: set(np.argsort(-np.where(np.arange(6000) == q, -np.inf, v @ v[q]))[:10].tolist()) for q in range(0, 6000, 20)}
    assert sum(g.vec_id in exact[g.query_id] for g in got) / 3000 >= 0.9
    assert len(reaches) == 1 and 0 < reaches[0] < most


def test_least_reach():
    ranks = np.array([[100, 50, 103, 90, 60], [10, 500, 200, 11, 490]])  # two probes, three neighbours, two curves
    reach, apart = vector_search.least_reach(ranks, np.array([0, 0, 1]), 2, 1.0, 1.0)
    assert apart.tolist() == [3, 1, 10] and reach == 10
    assert vector_search.least_reach(ranks, np.array([0, 0, 1]), 2, 0.5, 1.0)[0] == 3
    assert vector_search.least_reach(ranks, np.array([0, 0, 1]), 2, 1.0, 4.0)[0] == 44  # a sample of one in four: one place more


def test_hilbert_curve_is_continuous():
    side = 1 << 3
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    path = cells[np.argsort(vector_search.hilbert_keys(cells, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_pipeline_keeps_columns(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("kept", F.lit("clash")).withColumn("n_bytes", F.lit(1)).withColumn("blocks", F.lit(2))
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string")))
    from skein.llm.shared import cut

    counts = []
    for _, stage in pipeline.STAGES[:-1]:
        after = cut(stage(spark, docs, folder))
        assert after.schema.simpleString() == docs.schema.simpleString()
        counts.append(after.count())
        docs = after
    assert counts[0] > counts[1] >= counts[2] > 0
    assert docs.groupBy("doc_id").count().where("count > 3").isEmpty()
    plain, back = set_aside(docs, {"doc_id"})
    assert back(plain).columns == docs.columns
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
